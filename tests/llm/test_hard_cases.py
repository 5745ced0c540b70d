"""Hot keys, repeated rows, clashing names and whole-table comparisons with plain versions."""

import collections
import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import ann, chunks, decontaminate, extract, langid, mixing, packing, secrets, simhash, warc
from lumenframe.llm._common import new_folder, ranked, table

from test_operators import docs, words

MEDIUM = "/root/testdata/sf0.01"


def dotted(df):
    """df with columns whose names need quotes or clash with what operators use themselves."""
    return df.withColumns({"a.b": F.lit(1), "id": F.lit("x"), "node": F.lit(2.5), "_row": F.lit(None).cast("string"), "back`tick": F.array(F.lit(1))})


# ---- shared helpers
def test_ranked_is_the_order_however_it_is_cut(spark):
    r = np.random.default_rng(1)
    rows = [(int(x),) for x in r.permutation(5000)]
    for parts in (1, 7):
        got = ranked(spark.createDataFrame(rows, "v long").repartition(parts), ["v"]).collect()
        assert all(x.rank == x.v for x in got) and len(got) == 5000
    assert ranked(spark.createDataFrame([], "v long"), ["v"]).count() == 0


def test_session_settings_stay(spark, sf):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    secrets.op3_secrets(spark, sf)
    extract.op8_extract(spark, sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    secrets.op3_secrets(spark, sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_very_long_texts(spark):
    big = " ".join(["same"] * 20_000)
    long = ("lorem ipsum dolor " * 300_000)[:5_000_000]
    d = docs(spark, [big, long, None, "", long])
    assert [len(r.spans) for r in secrets.find_secrets(d).collect()] == [0] * 5
    got = {r.id: r.component for r in simhash.simhash_components(d).collect()}
    assert got[1] == got[4] == 1
    item = spark.createDataFrame([(0, big), (1, "same " * 50)], "item_id long, text string")
    began = time.time()
    assert {(r.id, r.item) for r in decontaminate.find_overlaps(d, item).collect()} == {(0, 0), (0, 1)}
    assert time.time() - began < 60


# ---- language identification
def test_every_label_is_learned(spark):
    rows = [(i, f"word{i % 230} text", f"l{i % 230:03d}") for i in range(690)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), windows=1)
    assert len(model.labels) == 230
    few = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), windows=1, all_labels=100)
    assert few.labels == model.labels


# ---- decontamination
def test_overlap_edges(spark):
    item = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")], "item_id long, text string")
    d = spark.createDataFrame([(None, "x one two three four five six seven eight nine ten eleven"), (4, "clean")], "doc_id long, text string")
    got = decontaminate.find_overlaps(d, item).collect()
    assert [(r.id, r.item, r.n_match) for r in got] == [(None, None, 11)]
    assert decontaminate.find_overlaps(d.limit(0), item).count() == 0 == decontaminate.find_overlaps(d, item.limit(0)).count()
    assert decontaminate.decontaminate(dotted(d), item).select("doc_id").collect()[0].doc_id == 4
    assert decontaminate.decontaminate(d.unionByName(d), item).count() == 2


@pytest.mark.parametrize("period", [1, 2, 3])
def test_repeated_words_make_few_hits(period):
    text = " ".join("abc"[i % period] for i in range(6000))
    index = decontaminate.Index([0], [text], 10)
    h, at = decontaminate.Hasher().many([text])
    assert sum(len(p) for p, _ in index.hits(h, at)) < 20 * len(h) * period
    assert index.overlaps(h, at) == [(0, 0, 0, 6000, 6000)]


def test_overlaps_against_all_alignments(spark, sf):
    """The tolerant rule itself, over all alignments of all documents and items."""
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    texts = [r.text for r in table(spark, sf, "documents").collect() if len(r.text) < 8000]
    index = decontaminate.Index(list(range(len(items))), items, 10)
    h, at = decontaminate.Hasher().many(texts)
    true = {}
    for r in range(len(texts)):
        doc = h[at[r] : at[r + 1]]
        for i in range(len(items)):
            item = index.h[index.at[i] : index.at[i + 1]]
            if not np.isin(item, doc).sum() >= min(8, len(item)):
                continue
            for s in range(1 - len(item), len(doc)):
                lo, hi = max(0, -s), min(len(item), len(doc) - s)
                a, b, match = decontaminate.best_stretch(item[lo:hi] == doc[lo + s : hi + s])
                if match == b - a == len(item) or (b - a >= 10 and len(item) >= 10):
                    true[r, i] = max(true.get((r, i), 0), match)
    assert {(r, i): m for r, i, _, _, m in index.overlaps(h, at)} == true and true


# ---- neighbours
def test_rows_that_repeat_an_id(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(120)] + [(50, [1.0] * 6), (31, [2.0] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for x in ann.search(d, F.col("id") == 50, wanted=1.0).collect():
        got[x.rank].append(x.vec_id)
    assert sorted(got) == [1, 2, 3, 4, 5] and all(len(v) == 2 for v in got.values())
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = collections.Counter()
    for q in (50, 120):
        s = sorted((-float(x[q] @ x[j]), rows[j][0]) for j in range(len(rows)) if j != q)
        want.update((k + 1, s[k][1]) for k in range(5))
    assert want == collections.Counter((k, v) for k, vs in got.items() for v in vs)


def test_queries_of_small_parts_go_everywhere(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=3) * 0.01 + np.eye(3)[0 if i < 290 else 1]]) for i in range(294)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(d, F.col("id") >= 290, wanted=0.01, parts=4).groupBy("query_id").count().collect()
    assert {x.query_id: x["count"] for x in got} == {i: 5 for i in range(290, 294)}


# ---- substring dedup
def plain_windows(text, n=50):
    raw = (text or "").encode()
    first, last = chunks.word_places(raw)
    return {raw[a:b]: (int(a), int(b)) for a, b in zip(first, last[n - 1 :])}


def compare_with_windows(texts, got):
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for w in plain_windows(t):
            holders[w].add(i)
    spans = collections.defaultdict(list)
    for r in got:
        a, b = texts[r.id].encode(), texts[r.other_id].encode()
        assert a[r.first_byte : r.end_byte] == b[r.other_byte : r.other_byte + r.end_byte - r.first_byte] and r.n_words >= 50
        spans[r.id].append((r.first_byte, r.end_byte))
    for i, t in texts.items():
        shared = [at for w, at in plain_windows(t).items() if len(holders[w]) > 1]
        assert bool(shared) == (i in spans), i
        assert all(any(lo < b and a < hi for lo, hi in spans[i]) for a, b in shared), i


def test_passages_against_all_windows(spark):
    d = table(spark, MEDIUM, "documents").where(F.length("text") < 20_000)
    compare_with_windows({r.doc_id: r.text for r in d.collect()}, chunks.repeats(d).collect())


def test_passages_of_parts_and_of_repeated_words(spark):
    w = [f"w{i}x{(i * 7919) % 9973}" for i in range(4000)]
    p = w[:80]
    parts = [w[500:540] + p[:49] + w[600:640], w[700:740] + p[31:] + w[800:830], w[900:940] + p + w[1000:1040], w[1100:1120] + p + w[1200:1210]]
    same = [w[1300:1320] + ["spam"] * 70 + w[1400:1420], w[1500:1530] + ["spam"] * 55 + w[1600:1640], w[1700:1720] + ["a", "bb"] * 40 + w[1800:1820], w[1900:1930] + ["a", "bb"] * 30 + w[2000:2040]]
    edge = [w[2100:2149], w[2090:2149] + w[2500:2560], w[3000:3050], w[2900:2910] + w[3000:3050] + w[3500:3510], w[3100:3149] + w[3600:3601], w[3601:3602] + w[3100:3149]]
    texts = dict(enumerate(" ".join(x) for x in parts + same + edge))
    got = chunks.repeats(docs(spark, list(texts.values()))).collect()
    assert {r.id for r in got} == {2, 3, 4, 5, 6, 7, 10, 11}
    compare_with_windows(texts, got)


def test_passages_of_repeated_ids(spark):
    p = " ".join(words(40, 60))
    d = spark.createDataFrame([(1, p), (1, p), (2, f"x {p}"), (None, f"y {p} z"), (None, "other"), (2, "more")], "doc_id long, text string")
    got = {(r.id, r.other_id) for r in chunks.repeats(d).collect()}
    assert {i for i, _ in got} == {1, 2, None}
    unique = spark.createDataFrame([(1, p), (2, f"x {p}")], "doc_id long, text string")
    assert {(r.id, r.other_id) for r in chunks.repeats(unique).collect()} == {(1, 2), (2, 1)}
    out = chunks.remove_repeats(dotted(unique))
    assert out.columns == dotted(unique).columns and sorted(len(r.text) for r in out.collect()) == [2, len(p)]
    many = docs(spark, [f"{' '.join(words(800 + i, 5))} {p}" for i in range(300)])
    assert chunks.repeats(many).select("id").distinct().count() == 300


# ---- SimHash
def jaccard_groups(texts, least=0.8):
    sets = {i: {" ".join(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in texts.items()}
    at, up = collections.defaultdict(list), {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    near = set()
    for i in sorted(texts):
        shared = collections.Counter(j for s in sets[i] for j in at[s])
        for j, n in shared.items():
            if n >= least * (len(sets[i]) + len(sets[j]) - n):
                near |= {i, j}
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for s in sets[i]:
            at[s].append(i)
    return {i: root(i) for i in texts}, near


def test_near_groups_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in table(spark, MEDIUM, "documents").collect()}
    true, _ = jaccard_groups(texts)
    got = {r.i: r.kept.i for r in simhash.near_groups(table(spark, MEDIUM, "documents")).collect()}
    gone = {i for i in true if true[i] != i}
    lost = {i for i in gone if got[i] == i}
    assert len(lost) <= 0.05 * len(gone) and gone
    assert all(true[i] == true[got[i]] for i in got)  # nothing goes without a partner


def test_near_dedup_of_repeated_lines_and_families(spark):
    line = " ".join(words(60, 12))
    two = [f"{' '.join(words(61 + k, 200))} " + f"{line} " * 20 for k in range(2)]
    base = words(70, 300)
    family = []
    for k in range(40):  # copies of one text, less like each other than like it
        r, w = np.random.default_rng(900 + k), list(base)
        for at in r.choice(300, 5, replace=False):
            w[at] = f"edit{k}x{at}"
        family.append(" ".join(w))
    texts = [*two, f"{two[0]} " + f"{line} " * 20, *family, " ".join(base)]
    kept = {r.doc_id for r in simhash.near_dedup(dotted(docs(spark, texts))).collect()}
    true, _ = jaccard_groups(dict(enumerate(texts)))
    assert kept == set(true.values())


def test_near_dedup_rows_that_repeat(spark):
    d = spark.createDataFrame([(1, "same text here", "b"), (1, "same text here", "a"), (1, "same text here", "a"), (None, "other words stand here", "c"), (None, None, "d")], "doc_id long, text string, x string")
    runs = [sorted(map(str, simhash.near_dedup(d.repartition(n)).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 3


def test_refinement_cuts_buckets(monkeypatch):
    """A bucket of one segment: nothing is compared twice over, and no link is lost."""
    monkeypatch.setattr(simhash, "REFINE", 64)
    r = np.random.default_rng(6)
    x = np.unique(np.concatenate([r.integers(0, 1 << 42, 3000).astype(np.uint64)] * 2))
    x = np.unique(np.concatenate([x, x[:300] ^ np.uint64(1), x[300:500] ^ np.uint64(1 << 41 | 4)]))[:, None]
    n, seen = len(x), []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda a: (seen.append(a.size), count(a))[1])
    got = simhash._large(x, np.arange(n), 2, np.array([~np.uint64(0)]))
    assert sum(seen) < n * n / 20
    monkeypatch.undo()
    near = [(i, int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :, 0] ^ x[i, 0]) <= 2) + i + 1]
    up = {i: i for i in range(n)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in got:
        assert np.bitwise_count(x[i, 0] ^ x[j, 0]) <= 2
        up[root(i)] = root(j)
    assert len(near) >= 400 and all(root(i) == root(j) for i, j in near)


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "REFINE", 20)
    monkeypatch.setattr(simhash, "HOT_BUCKETS", 1 << 40)
    r = np.random.default_rng(7)
    x = np.unique(np.concatenate([y := r.integers(0, 1 << 43, 200).astype(np.uint64), y[:60] ^ np.uint64(1 << 50), y[60:90] ^ np.uint64(1 << 3 | 1 << 30)]))
    nodes = spark.createDataFrame([(int(v.astype(np.int64)), bytearray(v.astype(">u8").tobytes())) for v in x], "node long, fp binary")
    got = {tuple(sorted((e.u, e.v))) for e in simhash.near_links(nodes, 2, 3).collect()}
    true = {tuple(sorted((int(a), int(b)))) for a in x for b in x if a < b and int(a ^ b).bit_count() <= 2}
    assert got == true and len(true) >= 90  # pairs here are apart from each other, so the forest is all of them


# ---- WARC
def test_archives_do_not_depend_on_partitions(spark):
    d = spark.range(50_000).select((F.col("id") * 3).alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.md5((F.col("id") % 40_000).cast("string")), 3).alias("html"))
    files, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        folder = new_folder(spark, "warc")
        warc.write(d.repartition(n), folder, shard_bytes=300_000, level=1)
        files.append({p.rsplit("/", 1)[1]: open(p, "rb").read() for p in glob.glob(f"{folder}/part-*")})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert files[0] == files[1] and len(files[0]) > 10
    first = sorted(glob.glob(f"{folder}/part-*"))[0]
    assert warc.read(spark, folder).count() == 50_000
    raw = open(first, "rb").read()
    for cut in (raw[: raw.index(b"\x1f\x8b\x08", 5)], raw[: len(raw) // 2], b""):
        with open(first, "wb") as f:
            f.write(cut)
        with pytest.raises(Exception, match="not those of the manifest|within a record"):
            warc.read(spark, folder).count()
    with pytest.raises(ValueError, match="committed"):
        warc.read(spark, new_folder(spark, "warc"))


# ---- extraction
def plain_main_lines(found, window):
    """The distribution by its definition."""
    marked = any(i and t for t, i, _ in found)
    size = [len(t) * ((1.0 if i else extract.OUTSIDE) if marked else (s <= 0.5)) for t, i, s in found]
    if not any(size):
        return []
    block = [sum(size[k : k + window]) for k in range(len(size))]
    level = extract.LEVEL[marked] * max(block)
    spans, k = [], 0
    while k < len(size):
        if not size[k]:
            k += 1
            continue
        a = b = k
        while any(size[b + 1 : b + 1 + window]):
            b += 1
        while not size[b]:
            b -= 1
        if any(block[j] > level and size[j] for j in range(a, b + 1)):
            spans.append((a, b))
        k = b + 1
    if not marked:
        spans = [(spans[0][0], spans[-1][1])]
    return [found[k][0] for a, b in spans for k in range(a, b + 1) if found[k][0]]


def test_distribution_against_its_definition(spark):
    pages = [r.html for r in table(spark, MEDIUM, "pages").collect()]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    for p in [*pages, *bare]:
        found = extract.lines(p)
        for window in (1, 2, 3, 5):
            assert extract.main_lines(found, window) == plain_main_lines(found, window)


def test_windows_decide():
    para = "<p>Some long text that goes on for a while, as articles do, and then on.</p>"
    page = f"<article>{para * 3}<div class=ad>x</div><p>z</p></article><p>{'outside text ' * 30}</p>"
    found = extract.lines(page)
    assert extract.main_lines(found, 3)[-1] == "z" and extract.main_lines(found, 1)[-1] != "z"
    assert not any("outside" in x for x in extract.main_lines(found, 3))


@pytest.mark.parametrize(
    "body,n",
    [
        ("<div>" + "".join(f"<p>{'word ' * 20}{i}</p>" + "<figure><img></figure>" * 4 * (i == 3) for i in range(10)) + "</div>", 10),
        ('<article><p class="related-work">Our work</p><p>x <math><mi>a</mi></math></p><p><a href=x>one link</a></p></article>', 3),
        ("<article><p>one</p>" + "<div class=ad>a</div><aside>b</aside>" * 4 + "<p>two</p></article>", 2),
    ],
)
def test_nothing_of_the_text_is_lost(body, n):
    assert len(extract.main_text(f"<body><nav>menu</nav>{body}<footer>f</footer>").split("\n")) == n


def test_extraction_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None)], "page_id long, url string, html string")
    assert [(r.id, r.text) for r in extract.extract(dotted(d)).collect()] == [(1, "a"), (1, "a"), (None, "")]
    assert extract.extract(d.limit(0)).count() == 0 == secrets.find_secrets(docs(spark, [])).count()


# ---- packing
def test_packing_keeps_null_ids_and_repeats_and_fills_rows(spark):
    d = spark.createDataFrame([(None, "a b c"), (7, "same"), (7, "same"), (8, None)], "doc_id long, text string")
    rows = packing.pack(dotted(d), length=16).collect()
    assert sorted(map(str, sum((r.doc_ids for r in rows), []))) == ["7", "7", "None"]
    rows = packing.op9_pack(spark, MEDIUM).collect()
    assert sum(r.n_tokens for r in rows) > 0.99 * len(rows) * packing.ROW - packing.ROW * 4
    texts = {r.doc_id: r.text for r in table(spark, MEDIUM, "documents").collect()}
    assert packing.unpack(rows, packing.vocabulary()) == {i: t for i, t in texts.items() if t}


# ---- mixing
def test_small_sources_come_near_their_targets(spark):
    r = np.random.default_rng(8)
    rows, k = [], 0
    for s in range(6):
        for n in np.exp(r.uniform(0, np.log(20_000 if s % 2 else 400), (10, 25, 50)[s % 3])).astype(int):
            rows.append((k, "w " * int(n), f"s{s}"))
            k += 1
    got = mixing.mix(dotted(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    taken = collections.Counter()
    for x in got.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect():
        taken[x.source] = x.n
    have = collections.Counter()
    for _, t, s in rows:
        have[s] += len(t.split())
    sources = spark.createDataFrame([(s, n, float(i % 3 + 1)) for i, (s, n) in enumerate(sorted(have.items()))], "source string, source_size long, weight double")
    for x in mixing.water_fill(sources, 3.0).collect():
        n = sum(r[2] == x.source for r in rows)
        assert abs(taken[x.source] - x.target) <= (0.1 if n == 10 else 0.02) * x.target, x


def test_balance_of_overlapping_constraints(spark):
    rows = [(i, 1 + i % 7, ["en"] * (i % 2) + ["web"] * (i % 3 > 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "i long, n long, has array<string>")
    targets = {"en": 1500.0, "web": 1200.0}
    got = mixing.balance(d, F.col("n"), F.col("has"), targets).collect()
    for name, want in targets.items():
        assert abs(sum(r.n * r.rate for r in got if name in r.has) - want) < 1e-4
    rate = {tuple(r.has): r.rate for r in got}
    assert rate[()] == 1 and abs(rate["en", "web"] - rate["en",] * rate["web",]) < 1e-9  # exponentially tilted
    with pytest.raises(RuntimeError, match="no rates"):
        mixing.balance(d.where("has = array('en')"), F.col("n"), F.col("has"), targets)


# ---- the pipeline
def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    d = table(spark, "/root/testdata/sf0.001", "documents")
    odd = d.limit(60).unionByName(d.limit(20)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "einige Worte hier und dort", None, None, 3), (5, "", "en", "a", 0)], d.schema))
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    for name, x in (("odd", dotted(odd)), ("none", d.limit(0))):
        x.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs_ = table(spark, f"{tmp_path}/{name}", "documents")
        for _, stage in p.STAGES[:-1]:
            docs_ = spark.createDataFrame(stage(spark, docs_, f"{tmp_path}/{name}").collect(), docs_.schema)
            assert docs_.columns == x.columns
        assert bool(p.run(spark, f"{tmp_path}/{name}").count()) == (name == "odd")
