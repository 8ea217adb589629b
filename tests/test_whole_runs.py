"""Whole runs, alternates, storage, readers and the command line, by hand on small rows."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftlake import __main__ as cli
from weftlake import settings
from weftlake.functions import content
from weftlake.operators import changes, dom, entries, ordering, reports, store
from weftlake.plans import doctor, resolve, run
from weftlake.policy import Policy
from weftlake.sources import readers, writers
from weftlake.streaming import live
from weftlake.streaming.monitor import Monitor

LONG = "<html><body><p>" + "This is a sentence. " * 200 + "</p></body></html>"
PAGES = "url string, status int, content_type string, text string, method string, fetched_at string, seq long"


def page(url, status=200, text=LONG, seq=0, kind="text/html", method="aiohttp"):
    return (url, status, kind, text, method, "2025-01-01", seq)


def test_rules_keep_repeated_rows_and_maps(spark):
    df = spark.createDataFrame([("https://www.nytimes.com/a", {"k": "v"}), ("https://www.nytimes.com/a", {"k": "v"}), ("https://x.org/b?page=2", None), (None, None)], "url string, m map<string,string>")
    rules = readers.rules_frame(spark, [{"domain": "nytimes.com", "target_template": "https://m/{original}"}, {"query_contains": {"page": "2"}, "target_url": "https://q/"}, {"path_regex": "(", "domain": "none.org", "target_url": "x"}])
    out = entries.apply_overrides(df, rules).collect()
    assert [(r["rule_priority"], r["target"]) for r in out] == [(0, "https://m/https://www.nytimes.com/a")] * 2 + [(1, "https://q/"), (None, None)]
    picked = entries.pick_selectors(df, readers.rules_frame(spark, [{"domain": "x.org", "fit_markdown_selectors": ["a"]}, {"domain": "x.org", "path_prefix": "/b", "fit_markdown_selectors": ["b", "c"]}, {"domain": "x.org", "path_prefix": "/b", "fit_markdown_selectors": ["d"]}])).collect()
    assert [r["selectors"] for r in picked] == [None, None, ["b", "c"], None]
    none = readers.rules_frame(spark, [])
    assert entries.apply_overrides(df, none).count() == 4 and entries.pick_selectors(df, none).count() == 4


@pytest.mark.parametrize("size", [1000, 7, 1])
def test_running_sums_are_carried(spark, size):
    data = [(k * 3 % 50, k % 4) for k in range(50)] + [(None, 9)]
    df = spark.createDataFrame(data, "seq long, v int").repartition(5)
    out = rows(ordering.running(df, "seq", size, total=F.col("v"), many=F.lit(1)))
    total, want = 0, []
    for n, (s, v) in enumerate(sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))):
        total += v
        want.append((s, v, total, n + 1))
    assert out == sorted(want, key=repr)
    assert sorted(r["n"] for r in ordering.numbered(df, "seq", "n", size).collect()) == list(range(51))
    assert ordering.running(df.where("false"), "seq", size, total=F.col("v")).count() == 0


def test_deep_pages():
    n = 100_000
    html = "<b>" * n + "deep deprecated definition" + "</b>" * n
    root = dom.tree(html)
    assert "deep" in dom.markdown(root) and dom.main_text("<p>" + html) and dom.hub(root, "http://h/")["body_chars"] == 26
    assert dom.deprecation(root, html).startswith("deep") and dom.definition(dom.tree("<div>" * n + "a definition" + "</div>" * n), "definition") == "a definition"
    assert dom.hub(dom.tree("<a href='/x'>" * n + "t"), "http://h/")["n_links"] == 1
    assert len(dom.clean_markup(html)) > 2 * n


def test_selectors():
    root = dom.tree("<main id='m'><div class='a b'><p data-x='one two'>x</p></div><section><p>y</p></section></main><p>z</p>")
    text = lambda sel: [n.text() for n in dom.find(root, sel)]
    assert text("main p") == ["x", "y"] and text("main > p") == [] and text("div.a.b > p") == ["x"] and text("#m section p, body, main p[data-x]") == ["x", "y"]
    assert text("[data-x*='tw']") == ["x"] and text("[data-x~=two]") == ["x"] and text("[data-x^='one']") == ["x"] and text("p[data-x$='o']") == ["x"] and text("!") == [] and text("*.a") == ["x"]


def test_main_text_and_markup():
    assert dom.main_text("<nav>n</nav><article> </article><main><script>s</script>body <b>text</b></main>") == "body text"
    assert dom.main_text("<div class='x-content-y'>in</div><p>out</p>") == "in" and dom.main_text("<p>a</p><p>b</p>") == "a b" and dom.main_text("") == ""
    assert dom.clean_markup("<p onclick='x' id=\"q\">a &lt; b<br><script>s</script><b>c") == '<p id="q">a &lt; b<br><b>c</b></p>'


def test_text_repair(spark):
    for given, want in (("cafÃ©", "café"), ("café", "café"), ("“q” ﬁ\r\nx​", '"q" fi\nx'), ("Ã", "Ã"), ("ＡＢ\u0007", "AB"), ("", ""), ("naïve Â£5", "naïve £5")):
        assert spark.range(1).select(content.minimal_fix(F.lit(given))).first()[0] == want
    assert spark.range(1).select(content.minimal_fix(F.lit(None).cast("string"))).first()[0] == ""
    assert content.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and content.decoded("é".encode("cp1252"), None) == "é" and content.decoded("é".encode(), "x; charset=nope") == "é"
    assert content.decoded("﻿é".encode("utf-16"), "") == "﻿é" or content.decoded("é".encode("utf-16"), "") == "é"


def test_settings():
    assert settings.split_list(" a, B ,,a ") == ("a", "B") and settings.int_list("1, x, 2,1,-3") == (1, 2, -3)
    assert [settings.as_bool(v, True) for v in (None, "", "0", "Off", "no", "yes")] == [True, True, False, False, False, True]
    assert settings.as_int(" 7 ") == 7 and settings.as_int("7x", 3) == 3 and settings.as_int(None) is None
    assert settings.normalize_set(["WWW.A.org.", "", "a.org", "www.org"]) == {"a.org", "www.org"}
    assert settings.run_folder("/b/", "r", {}) == "/b/r" and settings.cache_folder("/b", {"WEFTLAKE_CACHE_DISABLE": "1"}) is None and settings.cache_folder("/b", {}) == "/b/cache"


def test_pointers_count_as_texts(spark):
    df = run.annotate(spark.createDataFrame([page("http://a.org/1", seq=1), page("http://a.org/2", 404, "", 2)], PAGES))
    moved, texts = store.externalize(df, Policy(inline_bytes=0))
    flags = moved.withColumns({c: F.lit(False) for c in ("proxy_attempted", "proxy_used", "from_cache")})
    assert reports.run_metrics(flags).first()["success"] == 1
    inventory = entries.dedupe_merge(entries.build_entries(df.select("url", "seq")))
    assert [r["url"] for r in entries.outstanding_entries(inventory, moved).collect()] == ["http://a.org/2"]
    pointers, kept = store.extracted_texts(moved, texts)
    assert pointers.count() == 1 and kept.count() == 1
    stored = store.blob_bytes(df)
    told = store.verify_blobs(store.with_blob(df), stored).collect()
    assert [(r["postcheck_verdict"], r["postcheck_failed"]) for r in told] == [("ok", False)]
    held = store.with_blob(df.withColumn("raw_bytes", F.lit(b"%PDF")))
    assert {(r["blob_source"], r["blob_size"]) for r in held.collect()} == {("raw", 4)}
    assert rows(store.raw_text(held.select("seq", F.lit("").alias("text"), "blob_path"), None, held.select(F.col("blob_sha256").alias("sha256"), F.col("raw_bytes").alias("data")).distinct()).select("raw_text")) == [("%PDF",), ("%PDF",)]


def test_whole_run(spark, tmp_path):
    hub = "<body>" + "".join(f"<a href='/docs/{k}'>l</a>" for k in range(30)) + "</body>"
    glossary = "<body><h2>Definition</h2><div><h3>Definition of a term</h3><p>" + "what the term means here " * 3 + "</p></div></body>"
    pages = spark.createDataFrame([page("http://a.org/1", seq=1), page("http://a.org/hub", text=hub, seq=2), page("http://a.org/g", text=glossary, seq=3), page("http://a.org/4", 503, "", 4)], PAGES)
    urls_ = ["http://a.org/1", "http://a.org/hub", "http://a.org/g", "http://a.org/4", "HTTP://A.org/cached", "http://a.org/none"]
    inventory = entries.build_entries(spark.createDataFrame(list(enumerate(urls_)), "seq long, url string"))
    cache = spark.createDataFrame([("http://a.org/cached", 200, "text/html", LONG, "aiohttp", "2024-01-01")], "key string, status int, content_type string, text string, method string, fetched_at string")
    out = run.run_pipeline(inventory, pages, cache=cache, with_dom=True, domains=("a.org",), download_mode="download_only", externalize=True)
    got = {r["url"]: r for r in out.results.collect()}
    assert got["http://a.org/g"]["verdict"] == "ok" and "structured_definition" in got["http://a.org/g"]["reasons"] and got["HTTP://A.org/cached"]["from_cache"]
    assert sorted(r["url"] for r in out.outstanding.collect()) == ["http://a.org/4", "http://a.org/hub", "http://a.org/none"]
    assert out.children.where("kept").count() == 30 and out.texts.count() == 2 and out.bodies.count() >= 2
    assert out.audit.first()["requested"] == 6 and got["http://a.org/1"]["text"] == "" and got["http://a.org/1"]["text_path"]
    told = run.batch_check(inventory, pages)
    assert told["exit_code"] == 3 and told["success"] == 1
    assert run.batch_check(inventory.where("seq = 0"), pages)["exit_code"] == 0


def test_alternates(spark):
    inv = [(k, f"http://s{k}.org/p", [f"c{k}"]) for k in range(6)]
    inventory = entries.build_entries(spark.createDataFrame([(k, u) for k, u, _ in inv], "seq long, url string")).withColumn("controls", F.array(F.concat(F.lit("c"), F.col("seq").cast("string"))))
    results = run.annotate(spark.createDataFrame([page(u, 200 if k == 5 else 403, LONG if k == 5 else "", k) for k, u, _ in inv], PAGES)).withColumn("paywall_verdict", F.lit("likely"))
    good = [f"http://good{k}.org/" for k in range(5)]
    fetched = run.annotate(spark.createDataFrame([page(u, seq=100 + k) for k, u in enumerate(good)] + [page("http://bad.org/", 404, "", 200)], PAGES))
    rules = readers.rules_frame(spark, [{"domain": "s0.org", "target_url": good[0]}, {"domain": "s1.org", "target_url": "http://bad.org/"}])
    search = spark.createDataFrame([("http://s1.org/p", "http://x.com/login", 0), ("http://s1.org/p", good[1], 1), ("http://s2.org/p", "http://bad.org/", 0)], "url string, candidate string, rank int")
    archive = spark.createDataFrame([("http://s2.org/p", good[2])], "url string, candidate string")
    said = spark.createDataFrame([("http://s3.org/p", good[3], "t", "t", "open", "text", 0), ("http://s4.org/p", good[4], "t", "u", "open", "text", 0)], "old_url string, url string, title string, source_title string, summary string, html_excerpt string, rank int")
    out = resolve.resolve(inventory, results, fetched, rules, search, archive, said)
    assert rows(out.applied.select("control_id", "old_url", "new_url", "provider")) == [(f"c{k}", f"http://s{k}.org/p", good[k], p) for k, p in enumerate(("override", "search", "wayback", "suggestion"))]
    now = {r["url"]: r["status"] for r in out.results.collect()}
    assert set(now) == {*good[:4], "http://s4.org/p", "http://s5.org/p"} and now[good[2]] == 200
    moved = {r["seq"]: (r["url"], r["original_url"]) for r in out.inventory.collect()}
    assert moved[0] == (good[0], "http://s0.org/p") and moved[4] == ("http://s4.org/p", None)
    asked = []

    def fetch(candidates):
        asked.append(candidates)
        return fetched.join(candidates, "url", "left_semi")

    called = resolve.resolve(inventory, results, fetch, rules, search, archive, said)
    assert rows(called.applied) == rows(out.applied) and len(asked) >= 4 and rows(called.results.select("url", "status")) == rows(out.results.select("url", "status"))
    few = resolve.resolve(inventory, results, fetched, rules, search, archive, said, limit=1)
    assert rows(few.applied.select("provider")) == [("override",), ("search",)]
    assert resolve.resolve(inventory, results, fetched).applied.count() == 0


def test_readers_of_state(spark, tmp_path):
    assert readers.read_contexts(spark, f"{tmp_path}/none").count() == 0 and readers.read_cache(spark, f"{tmp_path}/none.json").count() == 0 and readers.read_rules(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": "a", "title": str(k)}) for k in range(3)))
    assert rows(readers.read_contexts(spark, f"{tmp_path}/c.jsonl").select("id", "title")) == [("a", "2")]
    (tmp_path / "cache.json").write_text(json.dumps({"http://a/": {"status": 200, "text": "x"}}))
    (tmp_path / "bad.json").write_text("{")
    assert rows(readers.read_cache(spark, f"{tmp_path}/cache.json").select("key", "status", "text")) == [("http://a/", 200, "x")] and readers.read_cache(spark, f"{tmp_path}/bad.json").count() == 0
    (tmp_path / "bad.rules").write_text("{}")
    assert readers.read_rules(spark, f"{tmp_path}/bad.rules").count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>é</p>")
    (tmp_path / "b.txt").write_text("x")
    got = {r["url"].rsplit("/", 1)[1]: (r["status"], r["text"], r["error"]) for p in ("in/a.html", "b.txt") for r in readers.read_html_files(spark, f"{tmp_path}/{p}", f"{tmp_path}/in").collect()}
    assert got == {"a.html": (200, "<p>é</p>", None), "b.txt": (0, None, "outside_of_root")}
    assert rows(readers.read_stdin_manifest(spark, ["# c\n", " http://a \n", "\n"])) == [("http://a",)]


def test_change_feed_goes_when_empty(spark, tmp_path):
    df = spark.createDataFrame([("http://h/a", "alpha", "t1", 1)], "url string, text string, fetched_at string, seq long")
    first = changes.detect_changes(df)
    assert writers.write_change_feed(first, f"{tmp_path}/feed") == 1
    record = json.loads(next(p for p in (tmp_path / "feed").iterdir() if p.suffix == ".json").read_text())
    assert record["url"] == "http://h/a" and len(record["content_sha256"]) == 64
    again = changes.detect_changes(df, changes.next_state(first))
    assert writers.write_change_feed(again, f"{tmp_path}/feed") == 0 and not (tmp_path / "feed").exists()


def test_command_line(spark, tmp_path, capsys):
    pages = spark.createDataFrame([page("http://a.org/1", seq=1), page("http://a.org/2", 404, "", 2)], PAGES)
    pages.write.parquet(f"{tmp_path}/pages")
    (tmp_path / "m.txt").write_text("# all\nhttp://a.org/1\nhttp://a.org/2\n")
    common = ["--pages", f"{tmp_path}/pages"]
    assert cli.main(["manifest", f"{tmp_path}/m.txt", *common, "--out", f"{tmp_path}/out", "--metrics-json", f"{tmp_path}/m.json", "--state", f"{tmp_path}/state", "--download-mode", "download_only"]) == 3
    told = json.loads((tmp_path / "m.json").read_text())
    assert told["total"] == 2 and told["success"] == 1 and told["outstanding"] == 1
    assert spark.read.json(f"{tmp_path}/out/outstanding/domains").first()["category"] == "broken_or_moved"
    assert spark.read.parquet(f"{tmp_path}/out/downloads").count() == 1 and spark.read.json(f"{tmp_path}/out/extracted").count() == 1 and spark.read.json(f"{tmp_path}/out/markdown_index").count() == 1
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out" / "summary" / "summary").glob("*.txt")))["total"] == 2 and "## Item 1" in "".join(p.read_text() for p in (tmp_path / "out" / "summary" / "walkthrough").glob("*.txt"))
    assert cli.main(["get", "http://a.org/1", *common]) == 0 and cli.main(["get", "http://a.org/9", *common]) == 3
    assert cli.main(["find", "SENTENCE", *common]) == 0 and cli.main(["find", "nothing", *common]) == 3
    assert cli.main(["--manifest", f"{tmp_path}/m.txt", "--dry-run"]) == 0
    assert cli.main(["doctor"]) in (0, 3) and '"checks"' in capsys.readouterr().out
    for wrong in (["get", "http://a"], ["manifest", f"{tmp_path}/m.txt"], ["nope"], ["manifest", f"{tmp_path}/m.txt", *common, "--out", "x", "--emit", "nope"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(wrong)
        assert stop.value.code == 2


def test_batches_tell_their_progress(spark, tmp_path):
    from weftlake.streaming import live

    spark.createDataFrame([page("http://a.org/1", seq=1)], PAGES).write.parquet(f"{tmp_path}/in")
    told = []

    def hook(number, n):
        told.append((number, n))
        raise ValueError("mine")

    stream = spark.readStream.schema(PAGES).parquet(f"{tmp_path}/in")
    q = live.each_batch(stream, run.annotate, lambda df: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/cp", hook).trigger(availableNow=True).start()
    q.awaitTermination()
    assert told == [(0, 1)] and spark.read.parquet(f"{tmp_path}/out").first()["verdict"] == "ok"


def test_doctor():
    assert doctor.report([doctor.check("a", True, ""), doctor.check("b", False, "", level="info")])["ok"]
    told = doctor.report([doctor.check("a", False, "", "do it", value="0123456789")])
    assert not told["ok"] and told["warnings"][0]["remedy"] == "do it" and told["checks"][0]["value"] == "0123...6789"


def test_monitor(spark, tmp_path):
    told, seen = [], []

    def hook(event, state):
        seen.append(event)
        raise ValueError("mine")

    m = Monitor(told.append, hook)
    spark.streams.addListener(m)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.txt").write_text("x\ny\n")
        q = spark.readStream.text(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).queryName("lines").start()
        q.awaitTermination()
        for _ in range(100):
            if "terminated" in seen:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(m)
    state = next(iter(m.state.values()))
    assert "started" in seen and "terminated" in seen and state["rows"] == 2 and "mine" in state["hook_error"] and json.loads(told[-1])


class Kept:
    """As much of a group's state as is used."""

    def __init__(self, value=None):
        self.value = value

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_a_url_of_one_row_costs_no_frame_but_its_result(monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("a frame is put together or sorted")

    monkeypatch.setattr(live.pd, "concat", never)
    monkeypatch.setattr(live.pd.DataFrame, "sort_values", never)
    state, frame = Kept(), lambda *rows_: live.pd.DataFrame(rows_, columns=["sha", "fetched_at", "seq"])
    (one,) = live._chain(("u",), iter([frame(("a", "t1", 1))]), state)
    assert one.values.tolist() == [["u", "t1", 1, "a", None, True]] and state.get == ("a",)
    (more,) = live._chain(("u",), iter([frame(("b", "t3", 3), ("a", "t2", 9)), frame(("b", None, 1), ("c", "t3", 2))]), state)
    assert more[["fetched_at", "seq", "content_sha256", "content_previous_sha256", "content_changed"]].values.tolist() == [["t2", 9, "a", "a", False], ["t3", 2, "c", "a", True], ["t3", 3, "b", "c", True], [None, 1, "b", "b", False]]
    assert state.get == ("b",)
