"""The operators on Spark tables: plain versions, and nulls, empty and repeated rows, ties, empty tables and further columns."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import class_lm, common, html_text, jaccard, mixture, pieces, quality, queries, token_file, topk, url_filter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

DOCS = "doc_id long, text string, source string, shard string, n int"
ROWS = [
    (1, "the cat sat on the mat and then it sat on the hat again", "a", "x", 1),
    (1, "the cat sat on the mat and then it sat on the hat again", "a", "y", 2),
    (2, None, None, "x", 3),
    (3, "", "", "x", 4),
    (None, "the cat sat on the mat and then it sat on the hat again", "b", "x", 5),
    (5, " \n\t ", "b", "x", 6),
    (6, "word " * 3000 + "end", "a", None, 7),
    (7, "one two", "a", "x", 8),
    (8, "one two", "a", "x", 9),
    (-4, "é世 ▁ x\n\ny", "b", "x", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3, "n")


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None)]
    up = {x: x for p in pairs for x in p if x is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if b is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---- 1


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3) / 2], i, "q") for i in range(120)]
    rows += [(500, [3e12, 1.0, 0.0], 1, "q"), (501, [-3e4, 1e5, 9.0], 1, "q"), (200, None, 1, "q"), (250, [1.0, None, 0.0], 1, "q"), (300, [1.0, float("nan"), 0.0], 1, "q"), (350, [float("inf"), 0.0, 0.0], 1, "q"), (None, [9.0, 9.0, 9.0], 1, "q"), (400, [1.0], 1, "q"), (401, [2.0], 1, "q"), (450, [], 1, "q"), (7, rows[7][1], 7, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int, shard string")
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(df, shard_rows=16, block_rows=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in whole if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
        assert got.pop(q, []) == [(k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best, 1)]
    assert not got
    assert topk.exact_top_k(df.limit(0)).count() == 0


# ---- 2


def plain_schedule(quotas):
    total, done, out = sum(quotas), [0] * len(quotas), []
    for t in range(1, total + 1):
        ready = [(-(-(done[i] + 1) * total // q), i) for i, q in enumerate(quotas) if done[i] < q and done[i] * total // q < t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def plain_mixture(blocks, quota):
    """Source of each slot: whole cycles, with what a source has left in its last."""
    left, out = dict(blocks), []
    names = sorted(blocks)
    while any(left.values()):
        quotas = [min(quota[n], left[n]) for n in names]
        out += [names[i] for i in plain_schedule([q for q in quotas if q or True])] if all(quotas) else [[n for n, q in zip(names, quotas) if q][i] for i in plain_schedule([q for q in quotas if q])]
        for n, q in zip(names, quotas):
            left[n] -= q
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 2, "c": 1}])
def test_mixture_equals_a_plain_simulation(spark, monkeypatch, weights):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 16)
    sizes = {"a": 230, "b": 41, "c": 57, None: 3}
    rows = [(k * 1000 + i, f"t{i}", s, "z") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    mixed = mixture.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, slot_kind string"), weights, cycle=20, block_docs=4).toPandas()
    assert sorted(mixed["doc_id"]) == sorted(r[0] for r in rows) and "slot_kind" in mixed
    key = {None: "n"} | {s: "s" + s for s in "abc"}
    blocks = {key[s]: -(-n // 4) for s, n in sizes.items()}
    if weights:
        quota = {key[s]: weights.get(s, 1) for s in sizes}
    else:
        root = sum(math.sqrt(n) for n in blocks.values())
        quota = {n: max(1, round(20 * math.sqrt(b) / root)) for n, b in blocks.items()}
    got = mixed.sort_values("slot").groupby("slot")["source"].agg(lambda x: key[None if x.isna().iloc[0] else x.iloc[0]] if len(set(map(str, x))) == 1 else "mixed").tolist()
    assert got == plain_mixture(blocks, quota)
    first = min(b // quota[n] for n, b in blocks.items()) * sum(quota.values())
    for n in blocks:  # less than one block off while all sources last
        share = quota[n] / sum(quota.values())
        assert all(abs(got[:t].count(n) - share * t) < 1 for t in range(first + 1))
    assert (mixed["slot"] < mixed["due"]).all() and mixed.groupby(["slot"]).size().max() == 4


def test_mixture_of_equal_rows_in_order(spark):
    rows = [(1, "same", "a", k) for k in range(40)] + [(None, None, None, k) for k in range(5)] + [(2, "same", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    first, second = (sorted((r["slot"], r["place"], r["doc_id"], r["other"]) for r in mixture.mix_sources(d, block_docs=4).collect() if r["doc_id"]) for d in (df, df.repartition(3, "other")))
    assert first == second and len({r[:2] for r in first}) == 41
    ordered = mixture.in_mixture_order(mixture.mix_sources(df, block_docs=4).withColumn("s", F.col("slot")), 3)
    parts = [[r["s"] for r in p] for p in ordered.rdd.glom().collect()]
    assert len(parts) == 3 and [s for p in parts for s in p] == sorted(s for p in parts for s in p) and all(parts)


def test_mixture_edges(spark, docs):
    clash = mixture.mix_sources(docs.withColumnRenamed("shard", "slot").withColumnRenamed("n", "__key"))
    assert sorted(clash.columns) == sorted(["doc_id", "text", "source", "slot_in", "__key", *mixture.SCHEDULE]) and clash.count() == len(ROWS)
    out = mixture.mix_sources(docs)
    assert out.count() == len(ROWS) and {r["source"] for r in out.collect()} == {"a", "b", "", None}
    assert mixture.mix_sources(docs.limit(0)).count() == 0
    assert mixture.in_mixture_order(out).columns == docs.columns


# ---- 3


def test_urls(spark):
    link = '<link href="%s" rel=canonical>'
    rows = [
        (1, "https://x.net/a", link % "https://example.org/es/1"), (2, "http://x.net/a#f", None), (3, "https://x.net/b", link % "/a"), (4, "https://x.org/q", link % "https://x.net/a"),
        (5, "https://y.net/", '<meta http-equiv="refresh" content="0; url=https://z.com/de/1">'), (6, None, "x"), (7, "no scheme", None), (8, "HTTPS://Example.ORG/en/12?x", ""), (9, "https://example.org/es/2", None),
        (10, "https://notcom/fr/", None), (11, "https://a.com/fr/1", None), (12, "https://example.org", None), (12, "https://example.org", None), (13, "https://w.net/", link % "https://v.net/?a=1&amp;b=2"), (14, "https://v.net/?a=1&b=2", link % "https://u.com/de/"), (15, "https://y.net/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("node", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages).collect()}
    assert got[8] == ("example.org", "/en/12", "example.org/en/1", "block", "rule")
    assert got[9][2:4] == ("example.org/es/", "block") and got[11][2:4] == ("com/fr/", "allow") and got[10][2:] == (None, "allow", "default")
    assert got[6] == ("", "", None, "allow", "default") == got[7] and got[12] == ("example.org", "", None, "allow", "default")
    # x.org is allowed explicitly, so its class is not blocked by example.org/es
    assert got[1][3:] == ("allow", "default") and got[4][2:4] == ("org/", "allow")
    assert got[5][3:] == ("block", "alias") == got[13][3:] == got[14][3:] == got[15][3:]
    without = url_filter.judge_urls(pages.where("page_id <> 4"))
    assert {r["page_id"] for r in without.where("decided_by = 'alias'").collect()} == {1, 3, 5, 13, 14, 15}
    more = spark.createDataFrame([("https://notcom/fr/", "https://q.com/de/")], "a string, b string")
    assert url_filter.judge_urls(pages, edges=more).where("page_id = 10").first()["verdict"] == "block"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_relative_targets(spark):
    from urllib.parse import urljoin

    bases = ["https://a.net/x/y/p.html?q=1#f", "https://a.net", "http://a.net/"]
    targets = ["page.html", "../x", "../../../z?k", "./", ".", "..", "?id=1", "/r/../s", "//b.net/c", "https://c.net/d/e", "a/./b/../c#g", "sub/p?u=http://h/", "#t", "mailto:x", "..a/.b"]
    cases = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(cases, "b string, t string").select("b", "t", url_filter.resolved(F.col("b"), F.col("t")).alias("u")).collect()
    assert {(r["b"], r["t"]): r["u"] for r in got} == {(b, t): None if t == "mailto:x" else urljoin(b, t) for b, t in cases}
    # urljoin leaves dots in whole URLs, RFC 3986 does not
    whole = spark.createDataFrame([("https://c.net/d/../e/./f?a/../b",)], "t string").select(url_filter.resolved(F.lit(bases[0]), F.col("t")).alias("u"))
    assert whole.first()["u"] == "https://c.net/e/f?a/../b"


def test_every_alias_of_a_page(spark):
    rows = [
        (1, "https://x.net/a/p", '<link rel=canonical href="page.html">'), (2, "https://x.net/a/page.html", '<meta http-equiv=refresh content="0; url=https://z.com/de/1">'),
        (3, "https://y.net/a/b/c", "<meta http-equiv='Refresh' content='0; url=../q'>"), (4, "https://y.net/a/q", '<link rel="canonical" href="https://k.net/">\n<LINK REL="shortlink Canonical" HREF="https://z.com/de/2">'),
        (5, "https://w.net/i?x", '<meta http-equiv="refresh" content="5"><meta content="3;?id=1" http-equiv=refresh>'), (6, "https://w.net/i?id=1", '<link rel=canonical href=//z.com/de/3>'),
        (7, "https://v.net/1", '<head><base href="/de/"><link rel=canonical href="4">'), (8, "https://v.net/de/4", '<base target=_top><base href="https://z.com/de/"><link rel=canonical href=x>'),
        (9, "https://u.net/1", '<link rel=canonicals href="https://z.com/de/"><link data-rel=canonical rel=icon href="https://z.com/de/"><meta name=refresh content="0; url=https://z.com/de/">'), (10, "no scheme", "<link rel=canonical href=x>"), (11, "https://t.net/", None),
    ]
    got = {r["page_id"]: r["decided_by"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "alias" if k <= 8 else "default" for k in range(1, 12)}


def test_a_hot_canonical_target(spark):
    rows = [(i, f"https://h{i % 50}.net/{i}", '<link rel=canonical href="https://hub.net/">') for i in range(400)]
    rows += [(400, "https://hub.net/", '<meta http-equiv=refresh content="0; url=https://z.com/de/1">'), (401, "https://other.net/", None)]
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {i: ("block", "alias") for i in range(401)} | {401: ("allow", "default")}
    allowed = spark.createDataFrame([*rows, (402, "https://x.org/", '<link rel=canonical href="https://hub.net/">')], "page_id long, url string, html string")
    assert url_filter.judge_urls(allowed).where("verdict = 'block'").count() == 0


# ---- 4


def test_archives(spark):
    long, rows = "x" * 100, []
    for i in range(60):
        rows.append((i, f"https://h{i % 7}.com/p", [long, "short", None, long + "é", ""][i % 5], "c"))
    rows += [(0, "https://a.b/", long, "c"), (None, None, long, "c"), (99, "bad\r\nurl", "y" * 99, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset string").repartition(5)
    folder = common.scratch(spark, "warc")
    index = warc.merge_runs(warc.write_archives(pages, folder, max_records=5), folder, fan_in=3, per_range=10)
    order = [(r["url_key"], r["timestamp"]) for r in index.orderBy("part", "rank").collect()]
    assert len(order) == len(rows) and order == sorted(order) and index.select("part").distinct().count() >= 2
    got = collections.Counter(tuple(r[:5]) for r in warc.read_archives(index, folder).collect())
    raw = [(p, (h or "").encode()) for p, _, h, _ in rows]
    first = {}
    for p, b in raw:
        if p is not None and len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    want = collections.Counter()
    for p, b in raw:
        again = p is not None and len(b) >= 100 and p > first[b]
        want[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)] += 1
    assert got == want
    assert warc.archive(pages.limit(0), common.scratch(spark, "warc")).count() == 0


# ---- 5


def test_quality(spark, docs):
    got = quality.judge_quality(docs, ("doc_id", "shard", "n")).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 11)) and not any(r["kept"] for r in got)
    assert [r["n_words"] for r in got] == [14, 14, 0, 0, 14, 0, 3001, 2, 2, 4]
    assert got[0]["n_repeat_words"] == 6 and got[6]["base_failed"] and got[6]["n_repeat_words"] == 3000
    assert quality.judge_quality(docs.limit(0)).count() == 0
    twice = quality.judge_quality(docs.withColumn("pattern", F.lit("p")).withColumn("kept", F.col("n")), ("doc_id", "pattern", "kept", "n"), store=False).orderBy("n").collect()
    assert [(r["n"], r["kept_in"], r["pattern"], r["n_words"], r["quality"]) for r in twice] == [(r["n"], r["n"], "p", r["n_words"], r["quality"]) for r in got]


@data
def test_quality_agrees_with_labels(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op5_quality_rules"](spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    judged = [(got[r["doc_id"]]["kept"], r["quality"]) for r in labels if not got[r["doc_id"]]["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.97


# ---- 6


def test_pieces_of_tables(spark, docs):
    path = pieces.default_model()
    got = collections.defaultdict(list)
    for r in pieces.encode_documents(docs, path, every=True).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(ROWS) and all(r["round_trip"] for x in got.values() for r in x)
    model = pieces.model(path)
    for doc, text, source, *_ in ROWS:
        best = model.encode(text or "", 4)
        r = got[doc].pop(0)
        assert r["ids"] == best[0][1].tolist() and r["scores"] == [s for s, _ in best] and r["n_ids"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(best[0][1].tobytes()) and r["segmentations"] == [ids.tolist() for _, ids in best]
        assert r["crc32s"] == [zlib.crc32(ids.tobytes()) for _, ids in best] and all(model.decode(ids) == (text or "") for _, ids in best)
    assert [tuple(r) for r in pieces.encode_documents(docs.where("n = 9"), path).select("n_ids", "score").collect()] == [(len(model.encode("one two")[0][1]), model.encode("one two")[0][0])]
    assert pieces.encode_documents(docs.limit(0), path).count() == 0


# ---- 7


def test_main_text(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav></header><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A  title</h1><p>First &lt;b&gt; paragraph\n with words.</p><p>Second one.<script>x()</script></p></article><aside class='sidebar'><p>Other stories you may like</p></aside>"
        "<div class='comments'><h3>Comments</h3><p>I disagree with this.</p></div><form><label>Mail</label><button>Send</button></form><footer>&copy; me</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", html, 5), (1, "u", html, 6), (2, None, None, 5), (3, "v", "", 5), (None, "w", "<script>1</script>", 5)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract_main_text(pages).select("page_id", "url", "text", "n_chars").collect()), key=str)
    text = "A title\nFirst <b> paragraph with words.\nSecond one."
    assert got.count((1, "u", text, len(text))) == 2 and (2, None, "", 0) in got and (3, "v", "", 0) in got and (None, "w", "", 0) in got
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


@data
def test_main_text_of_generated_articles(spark):
    import html
    import re

    for page, h, text in ((r["page_id"], r["html"], r["text"]) for r in queries.queries()["op7_html_text"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect()):
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", h, re.S)[1].replace("<br>", " "))
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert text == "\n".join(b for b in blocks if b), page


# ---- 8


def check_base(rows, got):
    counts, texts = collections.Counter(), []
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        held = zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
        texts.append((d, words, held))
        if not held:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, w, h in texts), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want


def test_class_model_edges(spark, docs):
    got = class_lm.score_documents(docs, chunk_tokens=20, rounds=1).collect()
    check_base([r[:2] for r in ROWS], got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert class_lm.score_documents(docs.limit(0)).count() == 0


def test_class_model_learns_what_follows_what(spark):
    rng = np.random.default_rng(4)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    rows = [(i, " ".join(w for _ in range(60) for w in (nouns[rng.integers(20)], verbs[rng.integers(20)]))) for i in range(60)]
    got = class_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), classes=4, rounds=6, chunk_tokens=900).collect()
    check_base(rows, got)
    held = [r for r in got if r["held_out"]]
    # one of 20 words after the other kind: a bit a word better than one of 40
    assert held and sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.2


def plain_class_scores(rows, classes, rounds, min_share):
    """Score of each row, as the documentation of the model says; and P(any word | class before) for each class."""
    x = class_lm.Exchange._x
    docs = [(zlib.crc32(str(d).encode()) % 10 != 0, [*t.encode().lower().split(), None]) for d, t in rows]
    count = collections.Counter(w for train, words in docs if train for w in words)
    total, n_classes, end = sum(count.values()), classes + class_lm.SHAPES + 1, classes + class_lm.SHAPES
    core = sorted((w for w in count if w is not None and count[w] >= max(2, math.ceil(min_share * total))), key=lambda w: (-count[w], np.uint64(class_lm.word_hash(w)).astype(np.int64)))
    share = np.cumsum([count[w] for w in core])
    kind = {w: classes + class_lm.shape(w) for _, words in docs for w in words if w is not None} | {None: end}
    kind |= {w: min(classes - 1, int(share[i] / share[-1] * classes)) for i, w in enumerate(core)}

    def counted():
        n, before, after = np.zeros((n_classes, n_classes)), collections.defaultdict(lambda: np.zeros(n_classes)), collections.defaultdict(lambda: np.zeros(n_classes))
        for train, words in docs:
            for a, b, c in zip([None, *words], words, [*words[1:], None]):
                if train:
                    n[kind[a], kind[b]] += 1
                    before[b][kind[a]] += 1
                    after[b][kind[c]] += b is not None
        return n, before, after

    for turn in range(rounds):
        n, before, after = counted()
        step = class_lm.Exchange(n)
        kind |= {w: step.best(before[w], after[w], kind[w], classes) for i, w in enumerate(core) if turn == 0 or i % 2 == turn % 2}
    n, before, after = counted()
    column, row, moved = n.sum(axis=0)[:classes], n.sum(axis=1)[:classes], {}
    for w in set(count) - set(core) - {None}:
        if count[w] > 1:
            gain = (x(n[:, :classes] + before[w][:, None]) - x(n[:, :classes])).sum(axis=0) + (x(n[:classes] + after[w]) - x(n[:classes])).sum(axis=1)
            gain -= x(column + before[w].sum()) - x(column) + x(row + after[w].sum()) - x(row)
            moved[w] = int(np.argmax(gain))
    kind |= moved
    n, _, _ = counted()
    size, kinds = np.zeros(n_classes), np.zeros(n_classes)
    for w, c in count.items():
        size[kind[w]] += c
        kinds[kind[w]] += 1
    room = np.array([0] * classes + [1] * class_lm.SHAPES + [0])
    follow = (n + 0.1) / (n.sum(axis=1, keepdims=True) + 0.1 * n_classes)

    def emits(w):
        return 1 if w is None else (count[w] + 0.1) / (size[kind[w]] + 0.1 * (kinds[kind[w]] + room[kind[w]]))

    within = room * 0.1 / np.maximum(0.1, size + 0.1 * (kinds + room))  # of a class: words not seen, then those seen
    for w in count:
        within[kind[w]] += emits(w)
    empty = kinds + room == 0  # an exchanged class that lost all its words
    scores = [sum(math.log10(follow[kind[a], kind[b]] * emits(b)) for a, b in zip([None, *words], words)) for _, words in docs]
    return scores, follow @ np.where(empty, 1, within), len(moved)


def test_class_scores_equal_a_plain_model(spark):
    rng = np.random.default_rng(9)
    words = [f"{c}{i}{p}" for i in range(60) for c in "kv" for p in ("", ".")]
    rows = [(i, " ".join(words[int(k)] for k in rng.zipf(1.3, int(rng.integers(1, 60))) % len(words))) for i in range(90)]
    want, every, moved = plain_class_scores(rows, 5, 3, 0.02)
    assert moved > 20 and np.abs(every - 1).max() < 1e-9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = class_lm.score_documents(df, classes=5, rounds=3, min_share=0.02, chunk_tokens=150).collect()
    check_base(rows, got)
    assert [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])] == pytest.approx(want, rel=1e-9)


# ---- 9


def test_token_files(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_file.read_token_files(token_file.write_token_files(docs, common.scratch(spark, "t"), path)).collect()
    encoder = token_file.WordEncoder(path)
    lengths = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str)
    ids = [(d, next(iter(encoder.encode([t or ""]))) + np.array([2], "<u4").tobytes()) for d, t, *_ in ROWS]
    assert lengths == sorted(((d, len(x) // 4, zlib.crc32(x)) for d, x in ids), key=str)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == [sum(x["n_tokens"] for x in in_order[:k]) for k in range(len(in_order))]
    named = [r["doc_id"] for r in in_order if r["doc_id"] is not None]
    assert named == sorted(named) and in_order[0]["doc_id"] is None
    empty = token_file.write_token_files(docs.limit(0), common.scratch(spark, "t"), path)
    assert token_file.read_token_files(empty).count() == 0


# ---- 10


def plain_classes(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else frozenset() for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    meet = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            meet[x].append(i)
    common_ = collections.Counter((i, j) for x in meet.values() for a, i in enumerate(x) for j in x[a + 1 :])
    for (i, j), c in common_.items():
        if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            up[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    return [(rows[i][0], min(x for x in ids[find(i)] if x is not None) if any(x is not None for x in ids[find(i)]) else None, links[i]) for i in range(len(rows))]


def near_rows(seed=1, families=12):
    rng = np.random.default_rng(seed)
    rows, doc = [], 0
    for _ in range(families):
        base = [f"w{x}" for x in rng.integers(0, 900, int(rng.integers(40, 160)))]
        for _ in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = f"e{rng.integers(10**6)}"
            rows.append((doc := doc + 1, " ".join(text)))
    return rows


def joined(df):
    return sorted((tuple(r) for r in jaccard.join_near_copies(df).select("doc_id", "class_id", "n_links").collect()), key=str)


def test_near_copies(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, labels string")
    want = sorted(plain_classes(rows), key=str)
    assert joined(df) == want and sum(r[2] for r in want) > 100
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 3)  # large groups, in many blocks
    assert joined(df) == want
    kept = jaccard.one_of_each(df.withColumnRenamed("labels", "__text"))
    assert kept.columns == ["doc_id", "text", "__text"]
    kept = jaccard.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in want}) and kept.columns == df.columns


def test_shortened_prefixes_find_the_links_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    rng, rows = np.random.default_rng(11), []
    for _ in range(120):  # one changed word in a text of 50 to 55: similarity of 0.80 to 0.82
        base = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(50, 56)))]
        other = list(base)
        other[int(rng.integers(10, 40))] = "new"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    drift = [f"c{x}" for x in range(400)]  # a chain: each text near the one before it, far from most
    rows += [(1000 + i, " ".join(drift[3 * i : 3 * i + 90])) for i in range(60)]
    got, want = joined(spark.createDataFrame(rows, "doc_id long, text string")), sorted(plain_classes(rows), key=str)
    lost = sum(w[2] for w in want) - sum(g[2] for g in got)
    assert 0 <= lost <= 2 and sum(w[2] for w in want) > 300  # the recall for links at the threshold is 0.9996
    if not lost:
        assert got == want


def test_null_and_repeated_ids_keep_their_links(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + ["x", "y"][k % 2 : k % 2 + 1] + base[k + 1 :]) for k in (3, 50, 90, 117)]
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, other), (7, other), (8, other + " end"), (None, other.replace("v5 ", "q ")), (9, "quite another one")]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(plain_classes(rows), key=str)


def test_trie_links_are_runs_of_sorted_labels(spark):
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, (90, 2, 4)).astype(np.uint16)
    rows = [(bytes([i]) * 16, labels[i].tobytes()) for i in range(90)]
    df = spark.createDataFrame(rows, "set_key binary, labels binary").repartition(5)
    got = [(bytes(r["a"]), bytes(r["b"]), r["depth"]) for r in jaccard.trie_links(df, 2, 4, 2).collect()]
    for level in (2, 3, 4):  # what links of a depth connect is what shares a prefix of it
        up = {k: k for k, _ in rows}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b, d in got:
            if d >= level:
                assert any((labels[a[0], t, :d] == labels[b[0], t, :d]).all() for t in range(2))
                up[find(a)] = find(b)
        nodes = collections.defaultdict(list)
        for i in range(90):
            for t in range(2):
                nodes[t, labels[i, t, :level].tobytes()].append(rows[i][0])
        assert all(find(x) == find(same[0]) for same in nodes.values() for x in same)
    assert len(got) <= 2 * 89 and len({b for _, b, _ in got}) > 50


def test_near_copy_edges(spark, docs):
    assert joined(docs) == sorted(plain_classes([r[:2] for r in ROWS]), key=str)
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(docs).collect()) == sorted(map(str, (1, 2, 3, 5, 6, 7, -4)))
    assert jaccard.join_near_copies(docs.limit(0)).count() == 0


def test_operators_leave_only_what_their_results_read(spark, docs):
    jvm = spark.sparkContext._jvm

    def left():
        path = jvm.org.apache.hadoop.fs.Path(common.scratch(spark, "x")).getParent()
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {f.getPath().getName() for f in system.listStatus(path)} if system.exists(path) else set()

    for run in (lambda: jaccard.one_of_each(docs), lambda: mixture.mix_sources(docs), lambda: class_lm.score_documents(docs, rounds=1), lambda: quality.judge_quality(docs)):
        before = left()
        out = run()
        assert len(left() - before) <= 3 and out.count() >= 0


# ---- oracles and the pipeline


@data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)


@data
def test_pipeline_equals_plain_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    votes = {d: quality.measure((r["text"] or "").encode()) for d, r in rows.items()}
    model = quality.fit(sorted(collections.Counter(tuple(v) for _, v in votes.values()).items()))
    kept = [d for d, (c, v) in votes.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and quality.posterior(np.array([v]), *model)[0] >= 0.5]
    classes = plain_classes([(d, rows[d]["text"]) for d in kept])
    stay = sorted({c for _, c, _ in classes})
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == stay
    encoder = pieces.model(pieces.default_model())
    for r in got:
        best = encoder.encode(rows[r["doc_id"]]["text"], 4)
        assert r["ids"] == best[0][1].tolist() and r["scores"] == [s for s, _ in best] and r["round_trip"]
    mixed = corpus_pipeline.mixture(spark, docs, DATA)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding"]


@data
def test_pipeline_rows_bear_the_mixture(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = sorted(corpus_pipeline.run(spark, DATA).select("doc_id", "source", "slot", "place").collect(), key=lambda r: (r["slot"], r["place"]))
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text").alias("h"))
    order = {r["doc_id"]: r["h"] for r in texts.collect()}
    members = collections.defaultdict(list)
    for r in got:
        members["n" if r["source"] is None else "s" + r["source"]].append(r["doc_id"])
    blocks = {}
    for s, ids in members.items():
        ids.sort(key=lambda d: (order[d], d))  # few rows: one bucket, so in order of the hash as it is
        blocks[s] = [ids[a : a + 16] for a in range(0, len(ids), 16)]
    root = sum(math.sqrt(len(b)) for b in blocks.values())
    quota = {s: max(1, round(1000 * math.sqrt(len(b)) / root)) for s, b in blocks.items()}
    queue = {s: iter(b) for s, b in blocks.items()}
    want = [next(queue[s]) for s in plain_mixture({s: len(b) for s, b in blocks.items()}, quota)]
    assert len(want) > 1 and [r["doc_id"] for r in got] == [d for block in want for d in block]
    assert [(r["slot"], r["place"]) for r in got] == [(t, i) for t, block in enumerate(want) for i in range(len(block))]
