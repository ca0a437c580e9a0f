"""Stitching, contract, breaks, daily signals, graph, text, sources and streams on small inputs."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_golden import MID, frame, months, values
from tidemark.functions import display
from tidemark.operators import breaks, contract, forecast, graph, series, short_term, stitch, text
from tidemark.sources import artifact, runs
from tidemark.streaming import signals


def windows(spark, *parts):
    rows = [("s", i, dt.date(2024, m, 1), q) for i, part in enumerate(parts) for m, q in part]
    return spark.createDataFrame(rows, "phrase string, window_id int, period date, queries bigint")


def test_stitch_uses_a_bridge_and_reports_errors(spark):
    a, b, bridge = [(m, m) for m in (1, 2, 3)], [(m, m) for m in (6, 7, 8)], [(m, m) for m in (2, 3, 4, 5, 6, 7)]
    got = stitch.stitch(windows(spark, a, b, bridge)).collect()
    assert [r["queries"] for r in got] == list(range(1, 9)) and all(r["error"] is None for r in got)
    assert stitch.stitch(windows(spark, a, b)).first()["error"] == "gap"
    bad = [(2, 2), (3, 99), (4, 4)]
    assert stitch.stitch(windows(spark, a, bad)).first()["error"] == "mismatch"
    assert [(r["lo"], r["hi"]) for r in stitch.overlap_mismatch(windows(spark, a, bad)).collect()] == [(3, 99)]


def test_raw_files(spark, tmp_path):
    lines = ["Период;Число запросов;Доля от всех запросов, %;История запросов «ёлка купить»", "август 2024;997 977;0,0115;", "сентябрь 2024;1 004;0,01;"]
    run = tmp_path / "run1"
    run.mkdir()
    (run / "d.csv").write_bytes(b"\xef\xbb\xbf" + "\r".join(lines).encode() + b"\r")
    manifest = {"phrase": "ёлка купить", "region": "RU", "created_at": "2026-08-01T00:00:00+00:00", "exports": [{"view": "dynamics", "file": "d.csv"}, {"view": "top_related", "file": "r.parquet", "row_count": 2}]}
    (run / "manifest.json").write_text(json.dumps(manifest, ensure_ascii=False))
    spark.createDataFrame([("ёлка", "7"), ("  ", "3"), ("x", "-"), ("ёлка купить", "9")], "`Запросы со словами «ёлка купить»` string, `Число запросов` string").coalesce(1).write.parquet(str(run / "r.parquet"))
    got = runs.load_runs(spark, str(tmp_path)).orderBy("period").collect()
    assert [(r["phrase"], r["period"], r["queries"], r["share_pct"]) for r in got] == [("ёлка купить", dt.date(2024, 8, 1), 997977, 0.0115), ("ёлка купить", dt.date(2024, 9, 1), 1004, 0.01)]
    assert contract.contract_violations(runs.raw_monthly(spark, str(run / "d.csv"))).count() == 0
    files = spark.read.format("binaryFile").load(str(run / "d.csv"))
    assert contract.file_violations(files).count() == 0
    assert [tuple(r) for r in runs.edges(spark, str(tmp_path)).collect()] == [("ёлка купить", "ёлка", 7)]
    assert {r["check"] for r in runs.run_violations(spark, str(tmp_path)).collect()} == {"not-empty:top_related"}
    with pytest.raises(contract.ContractError):
        contract.require(runs.run_violations(spark, str(tmp_path)))


def test_daily_file_and_seeds(spark, tmp_path):
    rows = ["Дата;Число запросов;История «курсы»", "23.06.2026;1 200;", "24.06.2026;900;"]
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbf" + "\r".join(rows).encode())
    got = runs.load_daily(spark, str(tmp_path / "x.csv")).orderBy("day").collect()
    assert [(r["phrase"], r["day"].day, r["count"]) for r in got] == [("курсы", 23, 1200.0), ("курсы", 24, 900.0)]
    (tmp_path / "seeds.txt").write_text("# no\n\n a \nb\n")
    assert [r[0] for r in runs.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["a", "b"]


def daily(spark, counts, first=dt.date(2026, 6, 1)):
    return spark.createDataFrame([("p", first + dt.timedelta(days=i), float(c)) for i, c in enumerate(counts)], "phrase string, day date, count double")


def test_spike_is_found_and_judged_without_itself(spark):
    counts = [120] * 5 + [50] * 2
    x = counts * 4
    x[10] *= 2
    d = daily(spark, x)
    got = short_term.detect_spikes(d).collect()
    assert [(r["day"], round(r["expected"], 6)) for r in got] == [(dt.date(2026, 6, 11), 116.0)]
    assert short_term.detect_spikes(daily(spark, counts)).count() == 0
    report = short_term.short_term_report(d, 30).first()
    assert report["measured_through"] == dt.date(2026, 6, 28) and [s["ratio"] for s in report["spikes"]] == [2.069]
    profile = {r["weekday"]: r["profile"] for r in short_term.weekday_profile(daily(spark, x[:7])).collect()}
    assert abs(profile[0] / profile[6] - 2.4) < 1e-12 and abs(sum(profile.values()) - 7) < 1e-12


def base(seed=0, n=60, shock=None):
    rng = np.random.default_rng(seed)
    factor = np.array([1, 1.1, 1.2, 1, 0.9, 0.8, 0.8, 0.9, 1, 1.1, 1.3, 1.8])
    x = 10000 * factor[np.arange(n) % 12] * (1 + rng.normal(0, 0.03, n))
    for i, m in (shock or {}).items():
        x[i] *= m
    return x


def monthly_of(spark, x, name="a"):
    return spark.createDataFrame([(name, p, int(v)) for p, v in zip(months(dt.date(2019, 1, 1), len(x)), x)], "phrase string, period date, queries bigint")


def test_breaks(spark):
    assert breaks.classify_breaks(monthly_of(spark, base())).count() == 0
    one = breaks.classify_breaks(monthly_of(spark, base(shock={30: 4}))).collect()
    assert [(r["kind"], r["at"]) for r in one] == [("demand_transient", dt.date(2021, 6, 1))]
    shifted = monthly_of(spark, base(shock={i: 5 for i in range(30, 60)}))
    got = breaks.classify_breaks(shifted).collect()
    assert [(r["kind"], r["at"]) for r in got] == [("unresolved", dt.date(2021, 6, 1))] and abs(got[0]["delta"] - math.log(5)) < 0.1
    seam = spark.createDataFrame([("a", dt.date(2021, 7, 1))], "phrase string, period date")
    assert breaks.classify_breaks(shifted, seams=seam).first()["kind"] == "measurement"
    assert breaks.classify_breaks(shifted, events=seam).first()["kind"] == "demand_persistent"
    assert [r["handling"] for r in breaks.handling(breaks.classify_breaks(shifted)).collect()] == ["segment"]


def test_level_shifts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 0.3, rng.integers(3, 8)) for m in rng.normal(0, 2, 3)])

        def cost(cuts, x=x):
            e = [0, *cuts, len(x)]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(e, e[1:])) + len(cuts)

        n = len(x)
        best = min([[]] + [[a] for a in range(3, len(x) - 2)] + [[a, b] for a in range(3, len(x) - 5) for b in range(a + 3, len(x) - 2)] + [[a, b, c] for a in range(3, n - 8) for b in range(a + 3, n - 5) for c in range(b + 3, n - 2)], key=cost)
        assert cost(breaks.level_shifts(x)) <= cost(best) + 1e-9


def test_rolling_median_equals_pandas(spark):
    import pandas as pd

    x = np.random.default_rng(5).integers(1, 1000, 40)
    got = [r["level"] for r in breaks.rolling_median(monthly_of(spark, x)).orderBy("period").collect()]
    want = pd.Series(x.astype(float)).rolling(12, center=True, min_periods=12).median().bfill().ffill()
    assert got == want.tolist()


def test_folds_and_naive(spark):
    m = monthly_of(spark, np.arange(104))
    f = series.expanding_folds(m)
    assert {(r["fold"], r["part"]): r["n"] for r in f.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, "train"): 72, (0, "test"): 12, (1, "train"): 84, (1, "test"): 12}
    errors = series.mase(f, series.seasonal_naive(f)).collect()
    assert all(abs(r["mase"] - 12) < 1e-12 for r in errors)
    models = forecast.backtest(monthly_of(spark, base(n=104))).groupBy("model").agg(F.avg("mase").alias("m")).collect()
    m = {r["model"]: r["m"] for r in models}
    assert set(m) == set(forecast.MODELS) and m["auto_ets"] < m["naive"]


def test_chi2_tail():
    assert abs(forecast.chi2_tail(14.067140449, 7) - 0.05) < 1e-8 and abs(forecast.chi2_tail(3.841458821, 1) - 0.05) < 1e-8


def lookup(g):
    return lambda phrases: {p: g[p] for p in phrases if p in g}


def test_traversal_order_limits_and_resume():
    g = {"s": [("a", 5), ("b", 9), ("s", 99)], "a": [("c", 1)], "b": [("a", 5), ("d", 7)], "c": [], "d": [("e", 3)], "e": []}
    out = graph.traverse(["s"], lookup(g), graph.Limits(3, 2))
    assert out.state.visited == {"s": 0, "b": 1, "d": 2} and out.truncated_by_phrases
    more = graph.traverse(["s"], lookup(g), graph.Limits(100, 3), out.state)
    assert set(more.state.visited) == set("sbdaec") and not more.state.frontier
    again = graph.traverse(["s"], lookup(g), graph.Limits(100, 3), more.state)
    assert again.calls == 0
    waiting = graph.traverse(["s", "zz"], lookup(g))
    assert "zz" not in waiting.state.visited and [e.phrase for e in waiting.state.frontier if e.phrase == "zz"] == ["zz"]
    late = {"a": [("c", 10), ("b", 5)], "b": [("d", 1000)], "c": [("e", 3)], "d": [], "e": []}
    assert list(graph.traverse(["a"], lookup(late), graph.Limits(10, 2)).state.visited) == ["a", "c", "b", "d", "e"]
    with pytest.raises(ValueError):
        graph.traverse(["a"], lookup(late), graph.Limits(0, 2))


def one_by_one(g, seeds, most, deepest):
    """The same walk, one phrase at a time, from the definition."""
    visited, deep = {}, False
    entries = [(0, 0, s, 0) for s in seeds]
    while True:
        best = min((e for e in entries if e[2] not in visited and e[2] in g and e[3] <= deepest), default=None)
        deep |= any(e[3] > deepest and e[2] not in visited and (best is None or e[:3] < best[:3]) for e in entries)
        if best is None or len(visited) == most:
            return visited, best is not None, deep or any(e[3] > deepest and e[2] not in visited for e in entries)
        visited[best[2]] = best[3]
        entries += [(1, -f, p, best[3] + 1) for p, f in g[best[2]] if p != best[2] and p not in visited]


def test_traversal_equals_one_by_one(spark):
    import random

    rng = random.Random(5)
    for trial in range(60):
        names = [f"p{i}" for i in range(rng.choice([5, 15, 40]))]
        g = {n: [(rng.choice(names), rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(5))] for n in names if rng.random() < 0.9}
        seeds, most, deepest = rng.sample(names, 2), rng.choice([1, 4, 100]), rng.randrange(4)
        got = graph.traverse(seeds, lookup(g), graph.Limits(most, deepest))
        want, full, deep = one_by_one(g, seeds, most, deepest)
        assert list(got.state.visited.items()) == list(want.items()), trial
        # a phrase that is not available may or may not have been asked for before the walk was full
        assert got.truncated_by_phrases == full or len(g) < len(names), trial
        assert got.truncated_by_depth or not deep
    rows = [(a, b, f) for a, es in g.items() for b, f in dict(es).items() if a != b]
    e = spark.createDataFrame(rows, "src string, dst string, frequency bigint")
    table = {n: [(b, f) for a, b, f in rows if a == n] for n in names}
    for most in (3, 10):
        assert {r["phrase"]: r["depth"] for r in graph.priority_traversal(e, seeds, graph.Limits(most, 2)).collect()} == one_by_one(table, seeds, most, 2)[0]


def attach_in_turn(parts, least):
    """The series of windows {month: value} or its error, by attaching one window after the other."""
    left = sorted(parts, key=min)
    done = dict(left.pop(0))
    while left:
        w = max(left, key=lambda x: (len(x.keys() & done.keys()), -min(x)))
        left.remove(w)
        if len(w.keys() & done.keys()) < least:
            return "gap"
        if any(w[k] != done[k] for k in w.keys() & done.keys()):
            return "mismatch"
        done |= w
    return done if len(done) == max(done) - min(done) + 1 else "gap"


def test_stitch_equals_attaching_in_turn(spark):
    import random

    rng = random.Random(6)
    plans, rows = {}, []
    for i in range(150):
        parts = []
        for k in range(rng.randrange(1, 6)):
            a = rng.randrange(0, 12)
            w = {m: m * 10 for m in range(a, a + rng.randrange(1, 8)) if rng.random() < 0.97}
            if w and rng.random() < 0.08:
                w[rng.choice(list(w))] += 1
            if w:
                parts.append(w)
                rows += [(f"p{i}", k, months(dt.date(2020, 1, 1), 40)[m], q) for m, q in w.items()]
        if parts:
            plans[f"p{i}"] = parts
    got = {}
    for r in stitch.stitch(spark.createDataFrame(rows, "phrase string, window_id int, period date, queries bigint")).collect():
        got.setdefault(r["phrase"], r["error"] or {})
        if not r["error"]:
            got[r["phrase"]][(r["period"].year - 2020) * 12 + r["period"].month - 1] = r["queries"]
    want = {p: attach_in_turn(parts, 2) for p, parts in plans.items()}
    assert got == want and {x for x in want.values() if isinstance(x, str)} == {"gap", "mismatch"} and any(isinstance(x, dict) for x in want.values())


def test_stitch_expected_range_and_repeats(spark):
    w = windows(spark, [(2, 2), (3, 3), (4, 4), (4, 4)])
    assert stitch.stitch(w).count() == 3
    assert stitch.stitch(w, expected_from="2024-02-01", expected_to="2024-04-01").count() == 3
    assert stitch.stitch(w, expected_from="2024-01-01").first()["error"] == "gap" == stitch.stitch(w, expected_to="2024-05-01").first()["error"]
    assert stitch.stitch(windows(spark, [(2, 2), (2, 3)])).first()["error"] == "mismatch"


def test_niches_in_display_order_and_age_of_growing(spark):
    from tidemark.operators import ranking

    ranked = spark.createDataFrame(
        [("a", "STABLE", 0.0, 4, None), ("b", "STABLE", 0.0, 5, None), ("c", "GROWING", 0.5, 2, 7), ("d", "GROWING", 0.9, 1, 3), ("e", "GROWING", 0.4, 3, 5)],
        "phrase string, klass string, rank_score double, rank bigint, age int",
    )
    clusters = spark.createDataFrame([("aaa", "a"), ("aaa", "b"), ("aaa", "c"), ("zzz", "d"), ("mmm", "e")], "topic string, phrase string")
    records = ranked.select("phrase", F.lit(False).alias("filtered_out"))
    got = ranking.niche_order(ranking.build_niches(clusters, ranked, records)).orderBy("place").collect()
    assert [(r["topic"], r["age"], r["phrases"]) for r in got] == [("zzz", 3, ["d"]), ("mmm", 5, ["e"]), ("aaa", 7, ["c", "a", "b"])]


def test_guards(spark, tmp_path):
    nan = spark.createDataFrame([("x", p, float("nan") if i == 30 else 5.0) for i, p in enumerate(months(dt.date(2020, 1, 1), 40))], "phrase string, period date, queries double")
    assert [(r["phrase"], r["check"]) for r in series.growth_violations(nan).collect()] == [("x", "null")]
    with pytest.raises(series.BacktestError):
        forecast.backtest(nan)
    with pytest.raises(series.BacktestError):
        forecast.backtest(nan.limit(0))
    table = spark.createDataFrame([("x", "naive", 1.0, 2), ("y", "theta", 1.0, 2)], "phrase string, model string, mase_median double, n_folds bigint")
    with pytest.raises(series.BacktestError):
        series.backtest_summary(table.limit(0), "naive")
    with pytest.raises(Exception, match="no row of naive for y"):
        series.backtest_summary(table, "naive").collect()
    with pytest.raises(runs.ManifestError):
        runs.manifests(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty.csv").write_bytes(b"a;b;c;d\r")
    with pytest.raises(runs.EmptyDatasetError):
        runs.load_monthly(spark, str(tmp_path / "empty.csv"))
    assert artifact.load_showcase(spark, str(tmp_path / "none")) is None


def test_graph_tables(spark):
    e = spark.createDataFrame([("s", "a", 5), ("s", "b", 9), ("b", "d", 7), ("d", "e", 3), ("a", "s", 1)], "src string, dst string, frequency bigint")
    depth = values(graph.bfs_depth(e, spark.createDataFrame([("s",)], "phrase string"), 2))
    assert {k: r["depth"] for k, r in depth.items()} == {"s": 0, "a": 1, "b": 1, "d": 2}
    assert {k: r["depth"] for k, r in values(graph.priority_traversal(e, ["s"], graph.Limits(10, 2))).items()} == {"s": 0, "a": 1, "b": 1, "d": 2}
    f = spark.createDataFrame([("x", 3.0, False), ("y", 9.0, False), ("z", 1.0, True), ("y", 2.0, False), ("v", 50.0, False)], "phrase string, frequency double, is_seed boolean")
    seen = spark.createDataFrame([("v",)], "phrase string")
    assert [r["phrase"] for r in graph.pick_pending(f, seen, seen.limit(0), 2).orderBy("place").collect()] == ["z", "y"]
    assert graph.budget_left("2026-01-01", "2026-01-01", 7, 10) == 3 and graph.budget_left("2026-01-01", "2026-01-02", 7, 10) == 10


def test_state_round_trip(spark, tmp_path):
    path = f"file:{tmp_path}/state.json"
    assert artifact.load_state(spark, path) == (None, None)
    s = graph.State({"s": 0}, [graph.Entry(False, -float("inf"), "z", 0), graph.Entry(True, -4.0, "a", 1)])
    artifact.save_state(spark, path, s, "2026-01-01", 3)
    got, budget = artifact.load_state(spark, path)
    artifact.save_state(spark, path, s, "2026-01-01", 3)  # over the old one
    assert got.visited == s.visited and sorted(got.frontier) == sorted(s.frontier) and budget == {"date": "2026-01-01", "spent": 3}
    (tmp_path / ".state.json.crc").unlink(missing_ok=True)
    (tmp_path / "state.json").write_text("{}")
    with pytest.raises(artifact.ArtifactError):
        artifact.load_state(spark, path)


def test_silhouette_and_ari(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.3, (5, 2)) for c in (0, 3)])
    rows = [(i, i // 5, [float(v) for v in p]) for i, p in enumerate(pts)]
    v = spark.createDataFrame(rows, "id bigint, cluster int, embedding array<double>")
    got = {r["id"]: r["s"] for r in text.silhouette(v).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for i in range(10):
        own = [j for j in range(10) if j // 5 == i // 5 and j != i]
        a, b = d[i, own].mean(), d[i, [j for j in range(10) if j // 5 != i // 5]].mean()
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-12
    odd = v.union(spark.createDataFrame([(10, 7, [9.0, 9.0]), (11, 0, None), (12, None, [1.0, 1.0]), (None, 0, [0.0, 0.0])], v.schema))
    odd = {r["id"]: r["s"] for r in text.silhouette(odd).collect()}
    assert set(odd) == set(range(13)) and odd[10] == odd[11] == odd[12] == 0.0
    assert all(abs(odd[i] - got[i]) < 1e-12 for i in range(10))
    assert text.silhouette(v.limit(0)).count() == 0 and text.silhouette(v.where("id = 3")).first()["s"] == 0.0
    clusters, k, s = text.cluster_phrases(v.select("id", "embedding"), range(2, 4), restarts=2)
    assert k == 2 and s > 0.7
    pairs = v.join(clusters.withColumnRenamed("cluster", "b"), "id").select(F.col("cluster").alias("a"), "b")
    assert text.adjusted_rand(pairs).first()[0] == 1.0


def test_tokens_and_lemmas(spark):
    df = spark.createDataFrame([("Купить Айфон-15 про", 1), ("123", 2)], "phrase string, n int")
    d = spark.createDataFrame([("купить", "покупать")], "token string, lemma string")
    assert values(text.lemmas(df, d))["Купить Айфон-15 про"]["lemmas"] == ["покупать", "айфон", "про"]
    v = df.select(text.fake_embedding(F.array(F.lit("a"), F.lit("b"))).alias("v")).first()["v"]
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-12


def test_translate_survives_a_broken_service(spark):
    p = spark.createDataFrame([("a",), ("b",), ("a",)], "phrase string")
    cache = spark.createDataFrame([("a", "A")], "phrase string, translation string")

    def broken(_):
        raise OSError

    assert {r["phrase"]: r["origin"] for r in artifact.translate(p, cache, broken).collect()} == {"a": "cache", "b": "missing"}
    assert {r["phrase"]: r["translation"] for r in artifact.translate(p, cache, lambda x: [s.upper() for s in x]).collect()} == {"a": "A", "b": "B"}


def test_weekly_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = signals.weekly_counts(stream).writeStream.format("memory").outputMode("complete").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.select("phrase", "week", "n").collect())
    assert key(spark.table("weeks")) == key(signals.weekly_counts(events))


def test_upsert_latest_run(spark, tmp_path):
    up = signals.upsert_latest(str(tmp_path / "t"))
    for epoch, rows in enumerate([[("a", "2026-01-01", "r1")], [("a", "2026-02-01", "r2"), ("b", "2026-01-01", "r3")], [("a", "2026-01-15", "r0")]]):
        up(spark.createDataFrame(rows, "phrase string, created_at string, run_dir string"), epoch)
    assert sorted(r["run_dir"] for r in spark.read.parquet(str(tmp_path / "t" / "v0000000002")).collect()) == ["r2", "r3"]


def test_empty_inputs(spark):
    m = frame(spark, mid=MID).limit(0)
    assert series.growth_score(m).count() == 0 and series.month_continuity(m).count() == 0 and breaks.classify_breaks(m).count() == 0
    d = daily(spark, [1.0]).limit(0)
    assert short_term.detect_spikes(d).count() == 0


def test_status_escape_and_deltas(spark):
    none = spark.createDataFrame([], "phrase string, at int, error string")
    assert tuple(runs.run_status(none).first()) == (0, 0, None)
    some = spark.createDataFrame([("a", 1, "x"), ("b", 3, None), ("c", 2, "y"), ("b", 2, "z")], none.schema)
    assert tuple(runs.run_status(some).first()) == (1, 3, "y")
    texts = spark.createDataFrame([("a & <b>",), ("{{{x}}",), (None,)], "t string")
    assert [r[0] for r in texts.select(display.escape_data(F.col("t"))).collect()] == ["a &amp; &lt;b&gt;", "{ {{x}}", None]
    grid = spark.createDataFrame([("p", 14, True, 1.0, 2.0, 5.0, 9), ("p", 14, False, 4.0, 3.0, 2.0, 3), ("p", 21, False, 1.0, 1.0, 1.0, 1)], "phrase string, days int, seasonal boolean, aic double, aicc double, loglik double, k int")
    got = {r["days"]: tuple(r)[2:] for r in forecast.ic_deltas(grid).collect()}
    assert got == {14: (3.0, 6, -3.0, -1.0), 21: (None,) * 4}


def test_ets_season_by_month(spark):
    qs = [100 + 50 * (m.month == 12) + i % 3 for i, m in enumerate(months(dt.date(2019, 8, 1), 60))]
    rows = [("s", p, q) for p, q in zip(months(dt.date(2019, 8, 1), 60), qs)]
    got = forecast.ets_structure(spark.createDataFrame(rows, "phrase string, period date, queries bigint")).first()
    assert len(got["by_month"]) == 12 and int(np.argmax(got["by_month"])) == 11 and sorted(got["by_month"]) == sorted(got["seasonal"])


def test_share_and_chart_points(spark):
    got = spark.range(1).select(
        display.format_share(F.lit(0.1234)).alias("ru"), display.format_share(F.lit(0.5), "zh").alias("zh"), display.chart_points(F.array(*map(F.lit, (0.0, 5.0, 10.0)))).alias("p"), display.chart_points(F.array(F.lit(0.0))).alias("one")
    ).first()
    assert got["ru"] == "0,1234\u202f%" and got["zh"] == "0.5000%"
    assert [tuple(x) for x in got["p"]] == [(0.0, 100.0), (50.0, 50.0), (100.0, 0.0)] and [tuple(x) for x in got["one"]] == [(0.0, 100.0)]


def plain_ets(y, spec, sp, p, state):
    """Errors, means and last state of one candidate, point by point."""
    (e, t, _, s), (alpha, beta, gamma, phi) = spec, p
    level, trend, season = state[0], state[1], list(state[2:])
    errors, means = [], []
    for i, v in enumerate(y):
        base, c = level + (phi * trend if t == "A" else 0), season[i % sp]
        mu = {"N": base, "A": base + c, "M": base * c}[s]
        err = v - mu
        level = base + alpha * err / (c if s == "M" else 1)
        if t == "A":
            trend = phi * trend + beta * err / (c if s == "M" else 1)
        if s != "N":
            season[i % sp] = c + gamma * err / (base if s == "M" else 1)
        errors.append(err / mu if e == "M" else err)
        means.append(mu)
    return np.array(errors), np.array(means), np.array([level, trend, *season])


def test_ets_pass_equals_the_recursion():
    rng = np.random.default_rng(3)
    y = rng.uniform(50, 100, 30)
    for spec in forecast.ETS_SPECS:
        smooth = np.column_stack([rng.uniform(0.1, 0.9, (4, 3)) * [1, 0.2, 0.2], rng.uniform(0.8, 0.98, 4)])
        state = np.column_stack([rng.uniform(60, 90, 4), rng.normal(0, 1, 4), rng.uniform(0.8, 1.2, (4, 6))])
        got = forecast._ets_pass(y, spec, 6, smooth, state)
        for i in range(4):
            for a, b in zip(got, plain_ets(y, spec, 6, smooth[i], state[i])):
                assert np.allclose(a[i], b), spec


def test_ets_finds_the_weights_of_its_own_series():
    """Series drawn from each kind of model: the likelihood found is not below that of the values they were drawn with."""
    rng = np.random.default_rng(7)
    for spec in forecast.ETS_SPECS:
        e, t, _, s = spec
        p = (0.4, 0.05 if t == "A" else 0.0, 0.1 if s != "N" else 0.0, 0.95 if spec[2] else 1.0)
        season = np.array([1.2, 0.9, 1.1, 0.8]) if s == "M" else np.array([20.0, -10, 5, -15]) if s == "A" else np.zeros(4)
        state = np.r_[200.0, 1.0 if t == "A" else 0.0, season]
        noise, y = rng.normal(0, 0.02, 80), []
        for i in range(80):  # each point is the mean that follows from those before, and noise
            mu = plain_ets([*y, 1.0], spec, 4, p, state)[1][-1]
            y.append(mu * (1 + noise[i]) if e == "M" else mu + 200 * noise[i])
        y = np.array(y)
        errors, means, _ = plain_ets(y, spec, 4, p, state)
        drawn = -40 * np.log((errors**2).mean()) - (np.log(np.abs(means)).sum() if e == "M" else 0)
        fit = forecast.fit_ets(y, spec, 4)
        assert fit is not None and fit["loglik"] >= drawn, spec


def test_ets_odd_series():
    assert forecast.fit_ets(np.arange(20.0), ("A", "N", False, "A")) is None  # less than two seasons
    assert forecast.fit_ets(np.r_[0.0, np.arange(30.0)], ("M", "N", False, "N")) is None  # not positive
    flat = forecast.auto_ets(np.full(40, 7.0))
    assert np.allclose(forecast.ets_forecast(flat, 12), 7)


def test_structure_flips(spark):
    day = [dt.date(2026, 6, 1) + dt.timedelta(i) for i in range(56)]
    rows = [("week", d, 200 if d.weekday() < 5 else 40 + i % 3) for i, d in enumerate(day)] + [("zero", d, 0) for d in day] + [("short", d, 5) for d in day[:7]]
    daily = spark.createDataFrame(rows, "phrase string, day date, count bigint")
    got = {(r["phrase"], r["condition"], r["criterion"]): r for r in forecast.structure_flips(daily, reps=4).collect()}
    assert set(got) == {("week", c, i) for c in forecast.CONDITIONS for i in ("aic", "aicc")}
    assert all(r["reps"] == 4 and r["flips"] <= 4 for r in got.values())
    kept, noise = got["week", "seasonal", "aicc"], got["week", "noise", "aicc"]
    assert kept["seen_long"] == kept["seen_short"] == 4 and noise["seen_long"] <= 1
    again = {(r["phrase"], r["condition"], r["criterion"]): r for r in forecast.structure_flips(daily, reps=4).collect()}
    assert again == got


def test_detectors_say_no_where_they_cannot_work(spark):
    daily = spark.createDataFrame([("flat", dt.date(2026, 6, 1) + dt.timedelta(i), 5) for i in range(30)], "phrase string, day date, count bigint")
    got = forecast.detectors(daily).collect()
    assert len(got) == 7 and all(tuple(r)[2:] == (False, False, None, False, False) for r in got)
    assert forecast.detectors(daily.limit(0)).collect() == []


def test_translation_cache_file(spark, tmp_path):
    path = f"{tmp_path}/phrases.json"
    assert artifact.load_cache(spark, path).collect() == []
    rows = [("б", "B"), ("а", "A"), ("а", "A"), ("в", None)]
    artifact.save_cache(spark.createDataFrame(rows, "phrase string, translation string"), path)
    assert (tmp_path / "phrases.json").read_text() == '{\n  "а": "A",\n  "б": "B"\n}\n'
    assert [tuple(r) for r in artifact.load_cache(spark, path).orderBy("phrase").collect()] == [("а", "A"), ("б", "B")]
    artifact.save_cache(artifact.load_cache(spark, path).limit(0), path)
    assert artifact.load_cache(spark, path).collect() == []
    for broken in ("{", "[1]", '{"a": 1}'):
        (tmp_path / "x.json").write_text(broken)
        with pytest.raises(artifact.ArtifactError):
            artifact.load_cache(spark, f"{tmp_path}/x.json")
