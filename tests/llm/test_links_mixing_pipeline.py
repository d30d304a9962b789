import math
from collections import Counter

import pytest
from casefile.llm import links, mixing, queries, scratch
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, host string, verdict string"


def test_hosts_and_paths(spark):
    urls = ["HTTP://A.Example.COM/en/7?q#f", "x://h", "x://h?a/b", "x://h#/b", "no scheme", "", None, "://", "a://b/c://d/e", "http://u:1/É?x", "x://h\n/y\nz?q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(links.host_of(F.col("url")).alias("h"), links.path_of(F.col("url")).alias("p"))
    want = [("a.example.com", "/en/7"), ("h", ""), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("b", "/c://d/e"), ("u:1", "/É"), ("h\n", "/y\nz")]
    assert [tuple(r) for r in df.collect()] == want


def test_longest_rule_wins(spark):
    cases = [
        ("m.example.com", "/en/71", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("com", "/en/", "com/en/", "block"),
        ("xcom", "/en/", None, None), ("a.example.net", "/de/8", "example.net/de/8", "block"), ("b.net", "/de/8", "net/de/", "allow"), ("a.org", "/es", None, None), ("", "/en/", None, None),
    ]
    df = spark.createDataFrame(cases, "host string, path string, want string, verdict string").select("want", "verdict", links.rule_of(F.col("host"), F.col("path")).alias("r"))
    for r in df.collect():
        assert ((r.r.text, r.r.verdict) if r.r else (None, None)) == (r.want, r.verdict)


def test_propagation_by_hand(spark):
    """good -> a -> b, c -> bad: trust reaches b, distrust reaches c; hosts apart are allowed."""
    def page(i, host, path, *to):
        return (i, f"http://{host}{path}", "".join(f'<a href="https://{t}/x">t</a> <a HREF=\'/own\'>' for t in to), "", "")

    rows = [page(1, "good.net", "/de/", "a.info"), page(2, "a.info", "/", "b.info"), page(3, "b.info", "/"), page(4, "c.info", "/", "bad.org", "bad.org"), page(5, "bad.org", "/es/1"), page(6, "z.info", "/"), (7, None, None, "", ""), (7, "x", "", "", "")]
    got = {(r.page_id, r.host): r for r in links.judge_urls(spark.createDataFrame(rows, PAGES), damping_percent=50).collect()}
    assert len(got) == 7
    share = links.UNIT // 6
    assert (got[1, "good.net"].trust, got[2, "a.info"].trust, got[3, "b.info"].trust) == (share // 2, share // 2 // 2, share // 2 // 2 // 2)
    assert got[4, "c.info"].distrust == share // 2 // 2 and got[4, "c.info"].verdict == "block"
    assert {got[k].verdict for k in ((1, "good.net"), (2, "a.info"), (3, "b.info"), (6, "z.info"), (7, ""))} == {"allow"}
    assert links.judge_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_distrust_reaches_far_hosts(spark):
    """A chain of 30 hosts to a blocked one, and a host that links to a trusted and a blocked one alike."""
    page = lambda i, host, path, *to: (i, f"http://{host}{path}", "".join(f"<a href='http://{t}/'>" for t in to), "", "")
    rows = [page(i, f"h{i}.info", "/", f"h{i - 1}.info" if i else "bad.org") for i in range(30)] + [page(50, "bad.org", "/es/")]
    rows += [page(60, "even.info", "/", "bad.org"), page(61, "good.net", "/de/", "even.info")]
    rows += [(70, "http://long.info/" + "x" * 300_000, "<a href='http://bad.org/'>" + "<p>y</p>" * 100_000, "", "")]
    got = {r.page_id: r for r in links.judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i].verdict for i in [*range(30), 50, 70]} == {"block"} and got[29].distrust > 0 and len(got[70].path) == 300_001
    assert got[60].trust > got[60].distrust > 0 and got[60].verdict == got[61].verdict == "allow"


def pushed(edges, seeds, damping, least):
    """The walk by hand, round by round."""
    moving, mass = dict(seeds), Counter()
    while moving:
        nxt = Counter()
        for host, m in moving.items():
            mass[host] += m * (100 - damping) // 100
            to = [b for a, b in edges if a == host]
            for b in to if m > least else []:
                nxt[b] += m * damping // (100 * len(to))
        moving = {h: m for h, m in nxt.items() if m}
    return {h: m for h, m in mass.items() if m}


def test_walks_equal_rounds_by_hand(spark):
    import random

    r = random.Random(3)
    edges = {"trust": {(r.randrange(12), r.randrange(12)) for _ in range(30)}, "distrust": {(r.randrange(12), r.randrange(12)) for _ in range(20)}}
    seeds = {"trust": {1: 10**9, 2: 777}, "distrust": {3: 10**8}}
    table = spark.createDataFrame([(w, str(a), str(b)) for w, e in edges.items() for a, b in e], "walk string, src string, dst string")
    given = spark.createDataFrame([(w, str(h), m) for w, s in seeds.items() for h, m in s.items()], "walk string, host string, seed long")
    got = {(x.walk, int(x.host)): x.mass for x in links.spread(table, given, 85, 100).collect()}
    assert got == {(w, h): m for w in edges for h, m in pushed(edges[w], seeds[w], 85, 100).items()}


def test_domain_tree_edges(spark):
    hosts = spark.createDataFrame([("a.b.c.d",), ("c.d",), ("d.d",), ("b.c.dd",)], "host string")
    pages = spark.createDataFrame([], "url string, html string")
    assert {tuple(r) for r in links.host_edges(pages, hosts).collect()} == {("a.b.c.d", "c.d"), ("c.d", "a.b.c.d")}


def fill(sizes, weights=(1.0, 2.0, 3.0), most=3):
    """Targets by sharing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**share, **capped}
        capped.update(over)


def test_targets_by_water_filling(spark):
    sizes = {"b": 5, "a": 100, None: 1, "É": 40, "c": 0, "z": 2000}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(fill(sizes))


DOCS = "doc_id long, source string, size long, target string, key string"


def test_mix_meets_budgets(spark):
    rows = [(i, f"s{i % 5}", (i * 37) % 50, "t", "k") for i in range(1000)] + [(i, "small", 9, "", "") for i in range(2000, 2008)] + [(3000, None, 0, "", ""), (None, "s1", 7, "", ""), (5, "s0", 35, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, F.col("size"), bins=16).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.repeats <= 3 and r.taken == r.repeats * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(n for _, _, n, *_ in rows))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 25
    again = mixing.mix(docs.repartition(7), F.col("size"), bins=16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(spark.createDataFrame([], DOCS), F.col("size")).collect() == []


def test_bins_change_nothing_and_epochs_come_first(spark):
    rows = [(i, "ab"[i % 7 == 0], 10 + i % 9, "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    one, many = ({(r.doc_id, r.repeats) for r in mixing.mix(docs, F.col("size"), bins=b).collect()} for b in (1, 512))
    assert one == many
    for s in "ab":
        reps = {r for i, r in one if "ab"[i % 7 == 0] == s}
        assert max(reps) - min(reps) <= 1


def test_quality_weights_draw_better_documents(spark):
    rows = [(i, "s", 10, "", "") for i in range(600)] + [(10_000 + i, "t", 10, "", "") for i in range(600)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in range(600)], "doc_id long, quality_weight double")
    got = mixing.mix(spark.createDataFrame(rows, DOCS), F.col("size"), quality=quality).filter("source = 's' and picked").collect()
    assert len(got) == 400 and sum(r.doc_id % 2 for r in got) >= 280


def test_a_very_long_document_does_not_end_its_source(spark):
    """Greedy in key order: what does not fit is passed over, and the best fit comes last."""
    sizes = [300 + i % 7 for i in range(400)] + [60_000, 20_000, 5_000, 900]
    rows = [(i, "ab"[i % 2], n) for i, n in enumerate(sizes)] + [(10_000 + i, "c", 700 + i % 3) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    keys = {r.doc_id: r.k for r in docs.select("doc_id", (-F.log(mixing.unit(F.col("doc_id").cast("string"), "mix"))).alias("k")).collect()}
    for bins in (16, 4096):
        got = mixing.mix(docs, F.col("size"), bins=bins).collect()
        for source in "abc":
            mine = sorted((r for r in got if r.source == source), key=lambda r: keys[r.doc_id])
            gap, picked = mine[0].target - mine[0].epochs * mine[0].source_size, set()
            for r in mine:
                if r.size <= gap:
                    gap -= r.size
                    picked.add(r.doc_id)
            rest = [r for r in mine if r.doc_id not in picked and abs(gap - r.size) < gap]
            if rest:
                picked.add(min(rest, key=lambda r: (abs(gap - r.size), keys[r.doc_id])).doc_id)
            assert {r.doc_id for r in mine if r.picked} == picked
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 400


def test_unit_is_uniform(spark):
    u = [r.u for r in spark.range(2000).select(mixing.unit(F.col("id").cast("string"), "x").alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and math.isclose(sum(u) / len(u), 0.5, abs_tol=0.03)


def test_quality_from_labels(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert {tuple(r) for r in queries.quality_weights(labels).collect()} == {(1, 2.0), (2, 0.5)}


def test_scratch_is_shared(spark):
    df = scratch.written(spark.range(3), "x")
    assert df.count() == 3 and scratch.shared_dir(spark) in df.inputFiles()[0]
    assert scratch.qualified(spark, "/tmp/x").startswith("file:/")


# --- the pipeline ------------------------------------------------------------------------------------------------

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abeilnorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents(spark):
    base, passage = words(1, 200), words(2, 60)
    rows = [(i, words(100 + i, 80), "en", f"s{i % 3}", 1) for i in range(30)]
    near = base.split(" ")
    near[50] = "changed"
    rows += [(40, base, "en", "s0", 1), (41, base, "en", "s0", 1), (42, " ".join(near), "en", "s1", 1), (42, " ".join(near), "en", "s1", 1)]
    rows += [(50, f"{words(3, 90)} {passage}", "en", "s2", 1), (51, f"{passage} {words(4, 90)}", "en", "s2", 1)]
    rows += [(60, None, "en", "s0", 1), (61, "123 456", "en", "s0", 1), (62, "", None, "s0", 1), (None, words(5, 70), "en", "s1", 1)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = documents(spark), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.written(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, docs))
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen}
    everyone = {*range(30), 40, 41, 42, 50, 51, None}
    assert ids["language"] == everyone
    assert ids["near_copies"] == everyone - {41, 42}
    assert ids["passages"] == ids["near_copies"]
    texts = {r.doc_id: r.text for r in seen[2][1].collect()}
    assert texts[51] == words(4, 90) and texts[50].endswith(words(2, 60)) and texts[None] == words(5, 70)
    assert all(r.n_chars == len(r.text) for r in seen[2][1].collect())
    mixed = seen[3][1].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed} <= ids["passages"] and max(r["count"] for r in mixed) <= 3
    assert seen[4][1].count() == seen[3][1].count()


def test_stages_of_nothing_and_of_odd_rows(spark, tmp_path):
    """Empty tables and tables of letterless, null, very long and repeated texts go through all stages."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(1, "123", "en", "s", 3), (2, None, None, None, None), (2**60, words(8, 60_000), "en", "s", 1), (2**60, words(8, 60_000), "aa", "s", 1), (5, "one word", "en", None, 1), (5, "other text here", "en", None, 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.written(stage(spark, docs.withColumn("text_hash", F.lit("x")).withColumn("group", F.lit(0)), str(tmp_path)), "odd")
            if name == "near_copies" and rows:
                kept = sorted((r.doc_id, r.lang, len(r.text)) for r in docs.collect())
                assert [k[:2] for k in kept] == [(5, "en"), (5, "en"), (2**60, "aa")]
        assert (docs.count() > 0) == bool(rows)


def test_near_copies_of_texts_that_share_an_id(spark):
    """One of each group stays, whatever ids its texts have."""
    base, other = words(1, 80), words(2, 80)
    near = base.replace(base.split(" ")[40], "zzz", 1)
    rows = [(3, base, "a", "s", 1), (5, near, "b", "s", 1), (5, other, "c", "s", 1), (5, other, "a", "s", 1), (7, base, "d", "s", 1), (9, near + " end", "e", "s", 1)]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(3, "a"), (5, "a")]


def test_pipeline_runs_and_repeats(spark):
    d = "/root/testdata/sf0.001"
    a, b = (sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, d).select("doc_id", "ids_sha256").collect()) for _ in range(2))
    assert a == b and len(a) > 50


def folder(table):
    return table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_workspace_deletes_what_is_not_kept(spark):
    import os

    with scratch.Workspace() as outer:
        with scratch.Workspace() as inner:
            a = inner.keep(scratch.written(spark.range(3), "kept"))
            b = scratch.written(spark.range(2), "gone")
            gone = folder(b)
            path = inner.keep(scratch.new_path(spark, "files"))
            spark.range(1).write.parquet(path)
        assert a.count() == 3 and os.path.exists(folder(a))
        assert len(outer.paths) == 2 and not os.path.exists(gone)
        kept = folder(a)
    assert not os.path.exists(kept) and not os.path.exists(path.removeprefix("file://"))


def test_workspaces_of_two_threads_are_apart(spark):
    import os
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2, timeout=120)

    def run(first):
        with scratch.Workspace() as w:
            meet.wait()
            table = w.keep(scratch.written(spark.range(5), "thread"))
            meet.wait()
            if not first:
                meet.wait()
        if first:
            meet.wait()
        return table

    with ThreadPoolExecutor(2) as pool:
        tables = list(pool.map(run, (True, False)))
    assert [t.count() for t in tables] == [5, 5] and all(os.path.exists(folder(t)) for t in tables)


def test_only_what_results_read_stays(spark):
    """After each operator the folder holds its result's tables, and nothing after the workspace around it."""
    import os

    root = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    for name, most in (("op1_ngram_jaccard", 2), ("op2_link_filter", 1), ("op4_substring_dedup", 1), ("op5_nearest_neighbours", 2), ("op6_exact_top_k", 2), ("op7_mix_sources", 3), ("op10_warc_round_trip", 2)):
        with scratch.Workspace():
            got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert len(set(os.listdir(root)) - before) <= most, name
            assert got.count() > 0
        assert set(os.listdir(root)) == before


def test_a_cluster_names_its_folder():
    class Conf:
        def get(self, *_):
            return ""

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session())
