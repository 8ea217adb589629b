"""Joins, state, sinks, sources, streaming and whole runs."""

import difflib
import random
import re
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftlake.operators import changes, entries, reports, store
from weftlake.plans import run
from weftlake.policy import Policy
from weftlake.sources import readers, writers
from weftlake.streaming import live

INV = "url string, original_url string, domain string, controls array<string>, titles array<string>, frameworks array<string>, worksheets array<string>, instances array<struct<worksheet: string, row_index: bigint, title: string>>, seq long"


def test_dedupe_merge(spark):
    df = spark.createDataFrame(
        [("HTTP://A.org/x", None, "a", ["c2"], ["t"], [], ["w"], [("w", 1, "t")], 1), ("http://a.org:80/x", None, "b", ["c1", "c2"], [], None, ["v"], [("w", 1, "t"), ("w", 2, "t")], 2), ("http://b.org", None, "b", ["z", "y"], [], [], [], None, 3)],
        INV,
    )
    a, b = entries.dedupe_merge(df).orderBy("seq").collect()
    assert (a["domain"], a["controls"], a["worksheets"], len(a["instances"]), a["n_merged"]) == ("a", ["c1", "c2"], ["v", "w"], 2, 2)
    assert b["controls"] == ["z", "y"]  # one entry stays as it is


def test_changes_and_state(spark):
    schema = "url string, text string, fetched_at string, seq long"
    first = spark.createDataFrame([("http://H/a", "alpha", "t1", 1), ("http://h/a", "alpha", "t2", 2), ("http://h/a", "alpha beta", "t3", 3), ("http://h/b", "", "t1", 4)], schema)
    c = changes.detect_changes(first)
    assert rows(c.select("seq", "content_changed")) == [(1, True), (2, False), (3, True), (4, None)]
    raw = changes.detect_changes(first.withColumn("raw_bytes", F.when(F.col("seq") == 4, F.lit(b"\xff\x00"))))
    assert rows(raw.select("seq", "content_changed", "content_text_len").where("seq = 4")) == [(4, True, 0)]
    state = changes.next_state(c)
    again = changes.detect_changes(spark.createDataFrame([("http://h/a", "alpha beta", "t4", 5), ("http://h/c", "new", "t4", 6)], schema), state)
    assert rows(again.select("seq", "content_changed", "content_previous_fetched_at")) == [(5, False, "t3"), (6, True, None)]
    assert rows(changes.with_diff_ratio(again).select("seq", "content_diff_ratio")) == [(5, 1.0), (6, None)]
    assert rows(changes.next_state(again, state).select("url_norm", "length")) == [("http://h/a", 10), ("http://h/c", 3)]


def test_externalize(spark):
    df = spark.createDataFrame([(1, "x" * 32), (2, "short"), (3, None)], "seq long, text string")
    out, blobs = store.externalize(df, Policy(inline_bytes=8))
    assert rows(out.select("seq", "text_externalized", "text")) == [(1, True, ""), (2, False, "short"), (3, False, None)]
    assert blobs.count() == 1
    assert store.externalize(df, Policy(inline_bytes=-1))[1].count() == 0
    assert store.externalize(df, Policy(inline_bytes=0))[1].count() == 2


def test_cache(spark):
    cache = spark.createDataFrame([("http://h/x", "1", "t1"), ("http://h/x", "2", "t2"), ("k", "3", "t0")], "key string, value string, fetched_at string")
    up = store.cache_upsert(cache.where("fetched_at = 't1'"), cache.where("fetched_at <> 't1'"))
    assert rows(up.select("key", "value")) == [("http://h/x", "2"), ("k", "3")]
    assert store.cache_prune(up, Policy(cache_entries=1)).first()["key"] == "http://h/x"
    got = store.cache_lookup(spark.createDataFrame([("HTTP://H/x",), ("k",), ("n",)], "url string"), up)
    assert rows(got.select("url", "cached")) == [("HTTP://H/x", "2"), ("k", "3"), ("n", None)]


def test_download_modes(spark):
    df = spark.createDataFrame([(1, "u", "One. Two. Three.", "ok"), (2, "v", "", "ok"), (3, "w", "x", "junk")], "seq long, url string, text string, verdict string")
    assert store.download(df, "nonsense").first()["download_mode"] == "text"
    assert len(store.download(df, "rolling_extract", Policy(window_size=8, window_step=4)).first()["windows"]) >= 2
    with pytest.raises(ValueError):
        store.download(df, "rolling_extract", Policy(window_size=2, window_step=4))
    assert rows(store.persist_downloads(df).select("seq", "error")) == [(1, None), (2, "download_missing_no_payload")]
    assert store.persist_downloads(df, True).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "m").write_text("# note\n\n http://a.org \nhttp://b.org\n")
    assert rows(readers.read_manifest(spark, str(tmp_path / "m"))) == [("http://a.org",), ("http://b.org",)]
    (tmp_path / "bad").write_text("http://a b\n")
    with pytest.raises(Exception, match="white space"):
        readers.read_manifest(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "i").write_text('{"url": "http://a.org", "controls": ["c"]}\n\n')
    assert readers.read_inventory(spark, str(tmp_path / "i")).first()["controls"] == ["c"]
    (tmp_path / "n").write_text('{"domain": "x"}\n')
    with pytest.raises(Exception, match="no url"):
        readers.read_inventory(spark, str(tmp_path / "n")).collect()
    (tmp_path / "c").write_text('{"id": "1", "t": "a"}\n{"id": "1", "t": "b"}\n')
    assert rows(readers.read_contexts(spark, str(tmp_path / "c"))) == [("1", "b")]
    (tmp_path / "r").write_text(json.dumps([{"domain": "a.org", "target_url": "x"}]))
    assert readers.read_rules(spark, str(tmp_path / "r")).count() == 1
    (tmp_path / "r2").write_text("{")
    assert readers.read_rules(spark, str(tmp_path / "r2")).count() == 0
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "p.html").write_text("<p>x</p>")
    assert readers.read_html_files(spark, str(tmp_path / "h")).first()["text"] == "<p>x</p>"


def pages(spark):
    return spark.createDataFrame(
        [("http://a.org/x", 200, "text/html", "<p>" + "A fine sentence. " * 150 + "</p>", "t1", 1), ("http://b.org/x", 404, "text/html", "<p>gone</p>", "t1", 2), ("http://c.org/x", 200, "text/html", "Subscribe. Log in.", "t1", 3)],
        "url string, status int, content_type string, text string, fetched_at string, seq long",
    )


def test_run_and_sinks(spark, tmp_path):
    inv = spark.createDataFrame([(u, None, None, ["c"], [], [], ["w"], None, k) for k, u in enumerate(["http://a.org/x", "http://b.org/x", "http://d.org/"])], INV)
    r = run.run_pipeline(inv, pages(spark))
    assert rows(r.results.select("seq", "verdict", "junk_reason")) == [(1, "ok", None), (2, "thin", "http_status_404"), (3, "paywall", "content_verdict_paywall")]
    assert rows(r.outstanding.select("url", "status")) == [("http://b.org/x", 404), ("http://d.org/", -1)]
    assert r.audit.first().asDict() == {"requested": 3, "fetched": 2, "failed": 1, "cache_hits": 0}
    writers.write_results(r.results, f"{tmp_path}/results")
    writers.write_junk(r.results, f"{tmp_path}/junk")
    writers.write_outstanding(r.outstanding, f"{tmp_path}/outstanding")
    writers.write_change_feed(r.changes.drop("previous_sample"), f"{tmp_path}/changes")
    writers.write_report(r.metrics, f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/results").count() == 3 and spark.read.json(f"{tmp_path}/junk/results").count() == 2
    assert json.loads(spark.read.text(f"{tmp_path}/metrics").first()[0])["total"] == 3
    assert run.fetch_one(pages(spark), "http://a.org/x").count() == 1


def test_dry_run(spark):
    df = spark.createDataFrame([("http://x.com/a",), ("ftp://b",), ("https://arxiv.org/c",)], "url string")
    assert run.dry_run(df).first().asDict() == {"total": 3, "valid": 2, "invalid": 1, "safe": 1, "resolver_candidates": 1}
    assert run.parse_emit("") == ("download", "text", "md") and run.parse_emit("md, text") == ("md", "text")
    with pytest.raises(ValueError):
        run.parse_emit("pdf")
    assert run.check_download_mode("x", 1, 1) == "text"


def test_ratios_of_equal_samples_need_neither_python_nor_texts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab cdXé\n") for _ in range(n))
    old = [word(n) for n in (1, 5, 199, 200, 201, 799, 800, 800)] + ["", "kept", "kept", "x" * 300]
    new = [s + word(r.choice([0, 3, 2000])) for s in old[:-4]] + ["", "", "kapt", "x" * 299 + "y" * 900]
    assert all(difflib.SequenceMatcher(None, s, s).ratio() == 1 for s in old)
    df = spark.createDataFrame([(f"http://h/{k}", t, f"t{j}", 2 * k + j) for k, pair in enumerate(zip(old, new)) for j, t in enumerate(pair)], "url string, text string, fetched_at string, seq long")
    out = changes.with_diff_ratio(changes.detect_changes(df)).select("seq", "content_diff_ratio")
    want = [(2 * k + 1, round(difflib.SequenceMatcher(None, a, b[: len(a)]).ratio(), 4) if a and b else None) for k, (a, b) in enumerate(zip(old, new))]
    assert rows(out) == sorted([*want, *((2 * k, None) for k in range(len(old)))], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [") :]
    shuffled = next(x for x in below.splitlines() if "- Project [" in x)
    assert below.count("RepartitionByExpression") == 1 and not re.search(r"[\[ ]text#\d+[,\]]", shuffled)


def test_filters_after_the_chain_stay_small(spark):
    plan = run.annotate(pages(spark)).where("verdict = 'ok' and paywall_verdict = 'unlikely'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


def test_stream_changes(spark, tmp_path):
    src, schema = tmp_path / "in", "url string, text string, fetched_at string, seq long"
    for k, rec in enumerate([("http://h/a", "alpha", "t1", 1), ("http://h/a", "alpha", "t2", 2), ("http://h/a", "beta", "t3", 3)]):
        spark.createDataFrame([rec], schema).coalesce(1).write.mode("append").json(f"{src}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(src))
    q = live.stream_changes(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["content_changed"] for r in spark.table("changed").collect()).count(False) == 1


def test_stream_rates(spark, tmp_path):
    spark.createDataFrame([("2025-01-01 00:10:00", "a", 1.0), ("2025-01-01 00:20:00", "a", 2.0), ("2025-01-01 09:00:00", "b", 1.0)], "ts string, event_type string, value double").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts string, event_type string, value double").parquet(f"{tmp_path}/e").withColumn("ts", F.to_timestamp("ts"))
    q = live.rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["key"], r["n"]) for r in spark.table("rates").collect()] == [("a", 2)]


def test_render(spark):
    lines = [r[0] for r in reports.render_table(spark.createDataFrame([("a", None)], "x string, y string")).collect()]
    assert lines == ["| x | y |", "|---|---|", "| a |  |"]


def test_replace_and_candidates(spark):
    r = spark.createDataFrame([("a", 404), ("b", 200)], "url string, status int")
    better = spark.createDataFrame([("a", "c", 200)], "replaces string, url string, status int")
    assert rows(entries.replace_results(r, better)) == [("b", 200), ("c", 200)]
    assert entries.first_pending(r.withColumn("seq", F.col("status")), 0).count() == 2
