"""What the operators do inside one process, against plain versions."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wearline.llm import class_lm, html_text, jaccard, quality, token_file, topk, warc

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXT = st.text(alphabet=st.sampled_from("ab cé\n\t.,'世　\x85 1▁|é"), max_size=40)


# ---- token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(0, 60000), st.sampled_from([0.0, 50.0, 95.0, 100.0]))
def test_blocks_round_trip(values, more, percentile):
    ids = np.concatenate([np.array(values, np.uint32), (np.arange(more // 5) * 7919 % 50257).astype(np.uint32)])
    assert (token_file.decode_blocks(token_file.encode_blocks(ids, percentile)) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(4096, 7, np.uint32)
    ids[::100] = 2**31
    (block,) = token_file.encode_blocks(ids)
    assert block[4] == 0 and len(block) < 4096 and (token_file.decode_blocks([block]) == ids).all()


def test_shard_reads_back(tmp_path):
    from pyarrow import fs

    docs = [(None, b""), (3, np.arange(9000, dtype="<u4").tobytes()), (3, b""), (7, np.array([5], "<u4").tobytes())]
    with open(tmp_path / "s", "wb") as f:
        assert token_file.write_shard(f, docs) == (4, 9001)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as f:
        shard = token_file.Shard(f)
        assert [(d, s, n) for d, s, n, _ in shard.documents()] == [(None, 0, 0), (3, 0, 9000), (3, 9000, 0), (7, 9000, 1)]
        assert [c for *_, c in shard.documents()] == [zlib.crc32(x) for _, x in docs]
        assert shard.ids(1).tolist() == list(range(9000)) and shard.ids(3).tolist() == [5] and shard.ids(0).tolist() == []


@pytest.fixture(scope="module")
def encoder():
    return token_file.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), room=50)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_words_encode_as_whole_texts(encoder, texts):
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


# ---- pieces


@pytest.fixture(scope="module")
def pieces():
    from wearline.llm.pieces import PieceModel, default_model

    return PieceModel(default_model(), room=200)


def every_segmentation(model, word):
    out = []

    def go(i, score):
        if i == len(word):
            out.append(score)
        for j in range(i + 1, min(len(word), i + model.longest) + 1):
            k = model.ids.get(word[i:j])
            if k is not None or j == i + 1:
                go(j, score + (model.scores[k] if k is not None else model.unknown))

    go(0, 0.0)
    return sorted(out, reverse=True)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("the in\n▁世é"), max_size=14), st.integers(1, 6))
def test_n_best_equals_enumeration(pieces, text, n):
    from wearline.llm.pieces import LITERAL, SPACE

    found = pieces.encode(text, n)
    whole = (SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else ""
    assert [s for s, _ in found] == every_segmentation(pieces, whole)[:n]
    assert all(pieces.decode(ids) == text for _, ids in found)
    assert len({ids.tobytes() for _, ids in found}) == len(found)


def test_long_words_and_a_full_table(pieces):
    texts = [" ".join(f"w{i}x{j}" for i in range(90)) for j in range(5)] + ["ab" * 3000]
    for text, found in zip(texts, pieces.encode_all(texts, 2)):
        assert pieces.decode(found[0][1]) == text and found[0][0] >= found[1][0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("theinxq\u4e16\u00e9\U0010fffe"), min_size=1, max_size=60))
def test_long_words_as_short_ones(pieces, word):
    (codes,), (best,), (loss,) = pieces._segment([word])
    assert pieces._segment_alone(word) == (codes, best, loss)


def test_very_long_texts_and_words():
    import time

    from wearline.llm.pieces import PieceModel, default_model

    model, rng = PieceModel(default_model()), np.random.default_rng(0)
    word = "".join(rng.choice(list("etaoinshr"), 200_000))
    many = " ".join(f"{x:x}" for x in rng.integers(0, 2**60, 400_000))
    began = time.process_time()
    for text, found in zip([word, many], model.encode_all([word, many], 3), strict=True):
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len(found) == 3
        assert all(model.decode(ids) == text for _, ids in found)
    assert time.process_time() - began < 120


def test_more_distinct_words_than_the_table_holds(pieces):
    from wearline.llm.pieces import PieceModel, default_model

    wide = PieceModel(default_model())
    words = [f"id{i * 7919 % 1000} the" for i in range(1000)]
    # the second text's own words fit once, beside those of the third they do not
    texts = ["\n".join(words), " ".join(f"a{i}" for i in range(150)), " ".join(f"a{i}" for i in range(100, 280)), "the end"]
    for text, small, large in zip(texts, pieces.encode_all(texts, 4), wide.encode_all(texts, 4), strict=True):
        assert [(s, ids.tolist()) for s, ids in small] == [(s, ids.tolist()) for s, ids in large]
        assert len(small) == 4 and all(pieces.decode(ids) == text for _, ids in small)


# ---- quality


def plain_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab  \n\t\x1c é世|#."), max_size=60))
def test_counts(text):
    assert quality.measure(text.encode())[0] == plain_counts(text)


def test_em_finds_rule_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    right_good, right_bad = np.linspace(0.85, 0.98, 8), np.linspace(0.6, 0.95, 8)
    votes = np.where(good[:, None], np.where(rng.random((20000, 8)) < right_good, 1, -1), np.where(rng.random((20000, 8)) < right_bad, -1, 1))
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns = list(collections.Counter(map(tuple, votes)).items())
    share, p_good, p_bad = quality.fit(patterns)
    assert abs(share - 0.8) < 0.02 and np.abs(p_good - right_good).max() < 0.03 and np.abs(1 - p_bad - right_bad).max() < 0.06
    assert ((quality.posterior(votes, share, p_good, p_bad) >= 0.5) == good).mean() > 0.97
    assert quality.fit([])[0] == 0.85


# ---- top k


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 7), st.booleans(), st.randoms(use_true_random=False))
def test_tree_equals_all_products(n, dim, k, large, rng):
    size = 2**31 - 1 if large else 3
    v = np.array([[rng.randint(-size, size) for _ in range(dim)] for _ in range(n)], np.int64)
    ids = np.arange(n) * 3 % n
    tree = topk.KDTree.load(topk.KDTree(v, ids, leaf=4).save())
    for q, found in zip(range(n), tree.search(v, ids.tolist(), k, [None] * n)):
        scores = sorted(((sum(int(a) * int(b) for a, b in zip(v[q], v[r])), -int(ids[r])) for r in range(n) if ids[r] != ids[q]), reverse=True)[:k]
        assert [(s, -i) for s, i in found] == scores


# ---- WARC


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter(sorted(r)) for r in runs])) == sorted(itertools.chain(*runs))


def test_records_round_trip():
    for page, url, payload, refers in ((1, "http://a.b/c\r\nX: y", b"abc" * 50, None), (None, None, b"", None), (9, "http://é/", b"\r\n\r\n" * 40, 2)):
        page2, size, digest, kind, refers2, body = warc.parse(warc.record(page, url, payload, refers, warc.EPOCH))
        assert (page2, size, refers2, kind) == (page, len(payload), refers, "revisit" if refers is not None else "response")
        assert body == (b"" if refers is not None else payload)
    assert warc.url_key("HTTP://WWW.Example.com/a?b#c") == "com,example,www)/a?b" and warc.url_key(None) == "-"


def test_runs_are_read_by_ranges(tmp_path):
    lines = [f"k{i:05d} x" for i in range(2000)]
    path = f"file://{tmp_path}/r.run"
    assert warc._write_run(path, iter(lines))[0] == 2000
    assert list(warc._read_run(path)) == lines
    assert list(warc._read_run(path, "k00700", "k00705")) == lines[700:705]


# ---- Jaccard


def plain_shingles(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingles_and_verification():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 50, 80)]
    texts = [" ".join(base[: 80 - k] + [f"n{k}{j}" for j in range(k)]) for k in range(0, 20, 2)] + ["a b", "a b c d e", ""]
    words = jaccard.Words()
    sets = [jaccard.shingles(t.encode(), words) for t in texts]
    assert [len(s) for s in sets] == [len(plain_shingles(t)) for t in texts]
    sets = [s for s in sets if len(s)]
    plain = [plain_shingles(t) for t in texts if plain_shingles(t)]
    copies = np.arange(1, len(sets) + 1)
    near = [[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(plain)] for i, a in enumerate(plain)]

    def verified(pairs):
        made = jaccard.Verifier(sets, copies)
        for i in range(len(sets)):
            made.check(i, np.array([j for j in range(i + 1, len(sets)) if pairs(i, j)], np.int64))
        linked = {(r[0], r[2]) for r in made.rows([bytes([k]) for k in range(len(sets))]) if r[2] is not None}
        assert len(linked) == len({b for _, b in linked}) < len(sets)
        assert made.found.sum() == sum(near[i][j] for i in range(len(sets)) for j in range(i) if pairs(j, i))
        return made.links.tolist()

    assert verified(lambda i, j: True) == [int(copies[np.array(row)].sum()) for row in near]
    assert verified(lambda i, j: (i < 4) != (j < 4)) == [int(copies[[j for j in range(len(sets)) if near[i][j] and (i < 4) != (j < 4)]].sum()) for i in range(len(sets))]


def test_prefixes_shorten_until_the_recall_is_met():
    found = np.zeros((jaccard.BANDS, jaccard.BINS), np.int64)
    # nothing known: as far as a link at the threshold needs
    assert [len(jaccard.unfinished(found, level)) == 0 for level in (8, 7, 6, 5)] == [False, False, False, True]
    found[:, -1] = 1000  # all links nearly equal: whole labels find them
    assert len(jaccard.unfinished(found, 8)) == 0
    found[3, 0] = 400  # one band with links at the threshold
    assert jaccard.unfinished(found, 8).tolist() == [3] and jaccard.unfinished(found, 6).tolist() == [3] and not len(jaccard.unfinished(found, 5))


def test_estimated_recall_is_the_recall():
    # links of many similarities, found or missed as the forest would: the estimate of the missed share holds
    rng = np.random.default_rng(8)
    s = 0.8 + 0.2 * rng.random(200_000) ** 2
    seen = rng.random(len(s)) < 1 - (1 - s**8) ** 20
    p = 1 - (1 - s[seen] ** 8) ** 20
    assert abs((1 / p - 1).sum() / (~seen).sum() - 1) < 0.1


# ---- HTML


def test_blocks():
    page = "<head><title>t</title></head><body><!-- x --><nav><a href='>'>Home</a></nav><p>a&amp;b <b>c<br>d<p>e\n  f<script>var t='</p>';</script><ul><li>g<li>h</ul>i <> j"
    found = html_text.blocks_of(page)
    assert [b.text for b in found] == ["Home", "a&b c d", "e f", "g", "h", "i <> j"]
    nav = html_text.step(html_text.step(html_text.Path(), "body"), "nav")
    assert found[0].linked == 4 and found[0].path == nav and nav != html_text.step(html_text.step(html_text.Path(), "nav"), "body")
    assert html_text.blocks_of("") == [] and html_text.blocks_of("<script>never closed") == []
    assert [b.text for b in html_text.blocks_of("<p title=\"a>b\">x</p><p 'y")] == ["x", "<p 'y"]


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    def seconds(page, blocks):
        began = time.process_time()
        found = html_text.blocks_of(page)
        assert len(found) == blocks
        return time.process_time() - began

    small, large = (seconds("<div class=a>x<b>y" * n + "</b></div>" * n, n) for n in (10_000, 80_000))
    assert large < 40 * max(small, 0.05)
    net = html_text.trained()
    page = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Some words of paragraph {i} that say what it says.</p>" for i in range(100_000)) + "</article><footer>Imprint</footer>"
    found = html_text.blocks_of(page)
    (kept,) = html_text.label(net, [found])
    assert len(found) == 100_002 and kept[1:-1].mean() > 0.99 and not kept[0] and not kept[-1]


def test_labels_do_not_depend_on_batches():
    net, made = html_text.trained(), [b for b, _ in html_text.training_pages(40, 99)]
    whole, parts = html_text.label(net, made), html_text.label(net, made, cells=1, at_once=3)
    assert all((a == b).all() for a, b in zip(whole, parts))


OTHER_LAYOUTS = [
    ("<div id=wrap><div class=masthead><ul><li><a href=/>Start</a><li><a href=/n>News</a></ul></div><div class=story><h2>{0}</h2><p>{1}</p><p>{2}</p></div><div class=sidebar><h4>Related</h4><a href=/a>Other things to read</a></div><div id=footer>All rights reserved</div></div>"),
    ("<table><tr><td><a href=/>Home</a> <a href=/b>Blog</a></td></tr><tr><td><h1>{0}</h1><p>{1}<p>{2}</td></tr><tr><td><small>Copyright 2020</small></td></tr></table>"),
    ("<header><nav><a href=/>Home</a></nav></header><main><section><h1>{0}</h1><p>{1}</p><p>{2}</p></section></main><section id=comments><h3>Comments</h3><p>I do not agree with any of this at all.</p></section><footer><p>Terms of use</p></footer>"),
]


def test_pages_without_an_article():
    words = [f"The {w} of the old harbour was built when the town had few ships and many plans." for w in ("wall", "gate", "bridge")]
    net, right, every = html_text.trained(), 0, 0
    for layout in OTHER_LAYOUTS:
        found = html_text.blocks_of(layout.format(*words))
        (kept,) = html_text.label(net, [found])
        for block, k in zip(found, kept):
            right += k == (block.text in words)
            every += 1
    assert right / every > 0.8


def test_lstm_gradient():
    net = html_text.BiLSTM(1, 5, 3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((4, 3, 5)), (rng.random((4, 3)) < 0.5).astype(float)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    _, grads = net.gradient(x, mask, y)
    for name, p in net.p.items():
        for at in list(np.ndindex(p.shape))[:6]:
            keep = p[at]
            p[at] = keep + 1e-4
            high = net.gradient(x, mask, y)[0]
            p[at] = keep - 1e-4
            low = net.gradient(x, mask, y)[0]
            p[at] = keep
            assert abs((high - low) / 2e-4 - grads[name][at]) < 1e-3


def test_labeller_on_held_out_pages():
    net = html_text.trained()
    made = html_text.training_pages(150, 12345)
    found = html_text.label(net, [b for b, _ in made])
    right = sum(int((f == (y > 0)).sum()) for f, (_, y) in zip(found, made))
    assert right / sum(len(y) for _, y in made) > 0.98


# ---- class model


def test_exchange_gains_are_likelihood_changes():
    rng = np.random.default_rng(2)
    classes, words = 3, rng.integers(0, 3, 12)
    stream = rng.integers(0, 12, 400)

    def bigrams(c):
        n = np.zeros((classes + 1, classes + 1))
        np.add.at(n, (c[stream[:-1]], c[stream[1:]]), 1)
        return n

    def likelihood(n):
        x = class_lm.Exchange._x
        return x(n).sum() - x(n.sum(axis=0)).sum() - x(n.sum(axis=1)).sum()

    # a word that never follows itself, so its own counts are exact
    stream = stream[np.append(True, (stream[1:] != 5) | (stream[:-1] != 5))]
    before = np.bincount(words[stream[:-1][stream[1:] == 5]], minlength=classes + 1)
    after = np.bincount(words[stream[1:][stream[:-1] == 5]], minlength=classes + 1)
    options = []
    for c in range(classes):
        moved = words.copy()
        moved[5] = c
        options.append(likelihood(bigrams(moved)))
    best = class_lm.Exchange(bigrams(words)).best(before, after, int(words[5]), classes)
    assert options[best] == pytest.approx(max(options))


def test_shapes_and_hashes():
    assert class_lm.word_hash(b"a") != class_lm.word_hash(b"b") and 0 <= class_lm.shape(b"end.") < class_lm.SHAPES
    assert class_lm.shape(b"!") < class_lm.SHAPES and class_lm.shape("né".encode()) < class_lm.SHAPES
