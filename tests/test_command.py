import os
import subprocess
import sys
from pathlib import Path


def test_contract_command(tmp_path):
    """Exit 0 for a clean file, 1 for a broken one, 2 if nothing is there."""
    root = str(Path(__file__).resolve().parents[1])
    head = "Период;Число запросов;Доля от всех запросов, %;История «a»\r"
    (tmp_path / "good.csv").write_bytes(b"\xef\xbb\xbf" + (head + "август 2024;1 000;0,5;\rсентябрь 2024;2;0,5;\r").encode())
    (tmp_path / "bad.csv").write_bytes((head + "август 2024;1 000;0.5;\r").encode())
    run = lambda *a: subprocess.run([sys.executable, "-m", "tidemark", *a], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert run(f"file:{tmp_path}/good.csv").returncode == 0
    bad = run(f"file:{tmp_path}/bad.csv")
    assert bad.returncode == 1 and "bom" in bad.stdout and "decimal-separator" in bad.stdout
    assert run(f"file:{tmp_path}/none.csv").returncode == 2
