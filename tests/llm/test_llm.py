import hashlib
import pathlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from kgspark.llm import common, compact_windows, decontaminate, fingerprints, html_wrappers, minhash_dedup, mixing, quality, queries, suffix_dedup, token_output, warc
from kgspark.llm import shingles as shingles_mod
from kgspark.llm.wavelet import WaveletMatrix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 70)
    texts = [base, base, None, "", "  \n ", "a b", "A b", "word " * 600, "aaaa" * 100]
    for _ in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts.append(" ".join(w))
    texts += [f"{prose(rng, rng.randint(0, 60))} {passage} {prose(rng, rng.randint(0, 60))}" for _ in range(15)]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(30)] + ["é" * 150 + prose(rng, 3000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en", [None, "a", "b", "ü"][i % 4], len(texts[k] or "")) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash_equals_brute_force(spark, corpus, docs, empty):
    sets = {r[0]: shingles(r[1]) for r in corpus}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert minhash_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, minhash_dedup.near_duplicates(odd).collect()), key=str) == sorted([(None, 2, None, None), (1, 2, 1, True), (1, 2, 1, True)], key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in common.components(edges).collect()} == {(i, 0) for i in range(51)}


def removed(corpus):
    seen, out = set(), {}
    for i, text, *_ in sorted(corpus):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 99):
            w = raw[j : j + 100]
            if w in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(corpus, docs, empty):
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed(corpus)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_a_crowded_gram(monkeypatch, corpus):
    """Contexts beyond GROUP are handed on by window; none is lost."""
    import pyarrow as pa

    rows = []
    for i, text, *_ in corpus:
        raw = (text or "").encode()
        for key, at, before, more in zip(*suffix_dedup.anchors(raw), strict=True):
            rows.append((int(key), raw[at - before : at - before + more + 100], int(before), i, int(at - before)))
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[4]))
    spans = {}
    for group in (10**6, 3):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        out = [r for b in suffix_dedup._repeats(iter([suffix_dedup._context_batch(rows)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        seen, cover = set(), set()
        for doc, a, b, window in sorted(out, key=lambda r: (r[0], r[1])):
            if window is None or window in seen:
                cover |= {(doc, j) for j in range(a, b)}
            seen |= {window}
        spans[group] = cover
        assert group > 3 or any(r[3] for r in out)
    assert spans[3] == spans[10**6] and pa


def test_blind_trie_sorts():
    rng = random.Random(1)
    for _ in range(100):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 25))]
        order, lcp = suffix_dedup.blind_trie(s)
        assert [s[i] for i in order] == sorted(s)
        assert lcp == [suffix_dedup._lcp(s[a], s[b]) for a, b in zip(order, order[1:], strict=False)]


def test_fingerprints(corpus, docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted(corpus)
    by_text = {}
    for k, (i, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        if edited == text:
            assert got[i].near_edited == 1
    assert fingerprints.fingerprints(empty).count() == 0


def test_mix(corpus, docs, empty):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus}
    own = {}
    for i, _, _, s, _ in corpus:
        own[s] = own.get(s, 0) + size[i]
    names = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, open_, budget, target = dict(zip(names, [3, 1, 2, 3], strict=True)), set(names), 1.5 * sum(own.values()), {}
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * own[s]}
        if not over:
            break
        target |= {s: 2.0 * own[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = dict.fromkeys(names, 0)
    for i, _, _, s, _ in corpus:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], own[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * size[i]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 for s in names)
    assert got == {r.doc_id: r for r in mixing.mix(docs.repartition(5)).collect()}
    assert mixing.mix(empty).count() == 0
    assert set(mixing.mixture(docs).columns) == set(docs.columns)


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 100):
        weights = {k: rng.choice([0, 1, 3, 10, 500]) for k in range(12)}
        rows = [(0, k, float(w), seats) for k, w in weights.items()]
        got = {r.k: r.quota for r in mixing.apportion(spark.createDataFrame(rows, "g int, k int, w double, s long"), "g", "k", "w", "s").collect()}
        best = sorted(((-w / (2 * j - 1), k) for k, w in weights.items() if w for j in range(1, seats + 1)))[:seats]
        assert got == {k: sum(x[1] == k for x in best) for k in weights}


PAGE = '<html><head><title>x</title><script>var a="</p>";</script></head><body><nav><a href=1>m</a></nav><article><h1>T &amp; {0}</h1><p>One <b>t</b>wo {0}<p>x<br>y<div class="share">Share</div></article><div id="comments"><p>c{0}</div><footer>f</footer>'


def test_main_texts(spark):
    rows = [(i, "http://a.example/1", PAGE.format(i)) for i in range(8)] + [(8, None, None), (9, "http://b.example", ""), (10, "u", "<p>only <i>text</i>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3][0] == "T & 3 One two 3 x y" and got[3][1] == len(got[3][0])
    assert got[8] == got[9] == ("", 0) and got[10][0] == "only text"


def test_main_text_of_deep_pages(spark):
    """Thousands of nested elements neither end the job nor change the order of the text."""
    n = 5000
    deep = "<article>" + "".join(f"<div>a{i} " for i in range(n)) + "".join(f"b{i}</div> " for i in range(n)) + "</article>"
    want = " ".join([*(f"a{i}" for i in range(n)), *(f"b{i}" for i in range(n))])
    rows = [(0, "http://deep.example", deep), (1, "http://deep.example", "<div>" * 50_000 + "x"), (2, "http://deep.example", "<article><p>y</article>")]
    got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == want and got[2] == "y"


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}%\n", "p" * 150 if i % 3 == 0 else f"<p>{i}</p>" * (i * 20)) for i in range(40)] + [(None, None, None), (41, "u", "p" * 99), (42, "u", "p" * 99)]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for size in (64, 10**6):
        got = warc.read_warc(files, size).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r for r in got}
        assert by[0].record_type == "response" and by[3].record_type == "revisit" and by[3].refers_to == 0 and by[3].payload_bytes == 150
        assert by[41].record_type == by[42].record_type == "response" and by[None].payload_bytes == 0
        for i, url, html in rows:
            assert by[i].url == url and by[i].payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for _ in range(100):
        h, t = rng.integers(0, int(rng.choice([6, 1000])), int(rng.integers(0, 100))).astype(np.uint64), int(rng.integers(1, 20))
        want = []
        for i in range(len(h)):
            a = b = i
            while a > 0 and h[a - 1] > h[i]:
                a -= 1
            while b < len(h) - 1 and h[b + 1] >= h[i]:
                b += 1
            if b - a + 1 >= t:
                want.append((i, a, b))
        assert list(zip(*(x.tolist() for x in compact_windows.compact_windows(h, t)), strict=True)) == want


def test_near_passages(spark, corpus, docs, empty):
    got = compact_windows.near_passages(docs).collect()
    sets = {r[0]: (r[1] or "").lower().split() for r in corpus}
    for r in got:
        x = shingles(" ".join(sets[r.doc_id][r.start_word : r.start_word + r.n_words]))
        y = shingles(" ".join(sets[r.match_doc_id][r.match_start_word : r.match_start_word + r.match_n_words]))
        assert r.match_doc_id < r.doc_id and min(r.n_words, r.match_n_words) >= 50
        assert r.n_shared == len(x & y) and r.jaccard == pytest.approx(len(x & y) / len(x | y)) and r.jaccard >= 0.75
    whole = {}
    for i in sorted(sets):  # every 70-word passage that an earlier document has is found
        runs = {tuple(sets[i][j : j + 70]) for j in range(len(sets[i]) - 69)}
        if runs & set(whole):
            assert i in {r.doc_id for r in got}
        whole |= dict.fromkeys(runs, i)
    assert compact_windows.near_passages(empty).count() == 0


def test_near_passages_behind_texts_that_hold_parts(spark):
    """The one text with the whole passage is neither the first nor the one before among those with its minima."""
    rng = random.Random(8)
    words = [f"x{i}" for i in range(20000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for g in range(10):
        left, right = some(35), some(35)
        parts = [f"{some(20)} {left} {some(60)} {right} {some(20)}" for _ in range(6)]
        whole = [f"{some(20)} {left} {right} {some(20)}" for _ in range(2)]
        rows += [(10 * g + k, t) for k, t in enumerate([*parts[:3], whole[0], *parts[3:], whole[1]])]
    got = {(r.match_doc_id, r.doc_id) for r in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(10 * g + 3, 10 * g + 7) for g in range(10)}


def test_near_passages_of_common_shingles_alone(spark, monkeypatch):
    """No shingle counts as uncommon, so the texts with the whole passage meet by what they hold in common with many."""
    monkeypatch.setattr(compact_windows, "COMMON", 0)
    rng = random.Random(8)
    words = [f"x{i}" for i in range(20000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for g in range(5):
        left, right = some(35), some(35)
        parts = [f"{some(20)} {left} {some(60)} {right} {some(20)}" for _ in range(6)]
        whole = [f"{some(20)} {left} {right} {some(20)}" for _ in range(2)]
        rows += [(10 * g + k, t) for k, t in enumerate([*parts[:3], whole[0], *parts[3:], whole[1]])]
    got = {(r.match_doc_id, r.doc_id) for r in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(10 * g + 3, 10 * g + 7) for g in range(5)}


def test_cells_that_share_a_run():
    """Against one pair after another: what is open in a cell shares a long enough run with the other's set."""
    rng = np.random.default_rng(13)
    length, percent = 10, 75
    x = [np.sort(rng.choice(30, int(rng.integers(10, 30)), False)).astype(np.int64) for _ in range(20)]
    at = [np.sort(rng.choice(40, len(v), False)) for v in x]
    y = [np.unique(rng.integers(0, 30, int(rng.integers(0, 40)))) for _ in range(30)]
    loss = 2 * percent / (100 - percent)  # of a place that is not shared
    want = set()
    for i, (v, a) in enumerate(zip(x, at, strict=True)):
        for j, w in enumerate(y):
            score = np.full(40, -loss)
            score[a[np.isin(v, w)]] = 1
            if any(score[b:e].sum() >= -1e-6 for b in range(31) for e in range(b + length, 41)):
                want.add((i, j))
    got = {(i, int(j)) for i, some in compact_windows._shared(x, at, np.full(20, 40), y, length, percent) for j in some}
    assert got == want and 0 < len(want) < 600


def test_staged_drops_shuffle_files(spark):
    before = spark.conf.get(common.CLEANUP)
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in folders for p in pathlib.Path(d).rglob("shuffle_*.data")}
    first = files()
    table = common.staged(spark.range(1000).selectExpr("id % 10 as k").repartition(5, "k").groupBy("k").count(), "counts")
    for _ in range(20):
        if not files() - first:
            break
        time.sleep(0.5)
    assert not files() - first and spark.conf.get(common.CLEANUP) == before
    assert table.count() == 10


def test_passages_of_one_region():
    """Two passages with changed words between; a wide run hidden by a short one of a higher sum; one beside a run that fails."""
    rng = np.random.default_rng(9)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    found = lambda x, y: sorted((a, b, c, d) for a, b, c, d, _ in compact_windows.passages(x, y, 46, 75))
    one, two = new(56), new(60)
    assert found(np.concatenate((one, new(24), two)), np.concatenate((one, new(24), two))) == [(0, 55, 0, 55), (80, 139, 80, 139)]
    assert found(np.concatenate((one, two)), np.concatenate((two, new(24), one))) == [(0, 55, 84, 139), (56, 115, 0, 59)]
    x = np.concatenate((one[:40], new(3), one[40:]))
    assert [(a, b) for a, b, *_ in found(x, np.concatenate((one[:40], new(3), one[40:])))] == [(0, 58)]
    loose = new(90)  # all of it shared, but scattered
    pieces = np.concatenate([np.concatenate((loose[k : k + 9], new(30))) for k in range(0, 90, 9)])
    assert found(np.concatenate((loose, new(24), two)), np.concatenate((pieces, two))) == [(114, 173, 390, 449)]


def test_near_passages_on_both_sides_of_changed_words(spark):
    rng = random.Random(10)
    one, two = ([f"y{rng.randrange(20000)}" for _ in range(60)] for _ in range(2))
    rows = [(k, " ".join([*one, *[f"z{k}{j}" for j in range(20)], *two])) for k in range(2)]
    got = {(r.doc_id, r.start_word, r.n_words) for r in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 60), (1, 80, 60)}


def test_decontaminate(spark, docs, empty):
    rng = random.Random(5)
    words = [f"b{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(14, 59)))) for i in range(20)] + [(90, None), (91, "a b"), (92, "")]
    rows, truth = [], {}
    for i in range(60):
        item = rng.randrange(20)
        w = items[item][1].split()
        for _ in range(rng.choice([0, 1, len(w) // 5])):
            w[rng.randrange(len(w))] = "zz"
        rows.append((1000 + i, f"{prose(rng, rng.choice([0, 40]))} {' '.join(w).upper()}, {prose(rng, rng.choice([0, 40]))}"))
        truth[1000 + i] = item
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == truth
    assert decontaminate.contaminated(docs, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()


def edits(a, b):
    """Fewest edits from a to any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def test_align_is_the_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, int(rng.integers(1, 12))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(1, 20))).astype(np.uint64)
        cost, start, end = decontaminate.align(a, b)
        assert cost == edits(a.tolist(), b.tolist())
        assert 0 <= start <= end <= len(b)


def test_windows_that_cannot_align_are_not_walked(monkeypatch):
    item = " ".join(f"b{i}" for i in range(40))
    held = decontaminate.Items([(1, item)])
    walked, real = [], decontaminate.samples
    monkeypatch.setattr(decontaminate, "samples", lambda w: walked.append(len(w)) or real(w))
    apart = "x y " + " ".join(["b5 b6 b7 b8 b9 u v w"] * 3)
    assert held.matches([apart]) == [] and not walked
    edited = item.replace("b9 ", "").replace("b20", "zz zz")
    assert [(t, i, e) for t, i, e, *_ in held.matches([apart, f"q r {edited} s", None])] == [(1, 1, 3)] and walked
    # no window that aligns is left out, over the ends of the words too
    rng = np.random.default_rng(3)
    items = decontaminate.Items([(k, " ".join(f"w{x}" for x in rng.integers(0, 12, 8))) for k in range(30)])
    words = np.concatenate([w[rng.random(len(w)) < 0.9] for w in items.words])
    its, at = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(-3, len(words)), indexing="ij"))
    ok = items.enough(its, at, items.numbered(words))
    for k, s, good in zip(its.tolist(), at.tolist(), ok.tolist(), strict=True):
        d = items.most[k]
        assert good or decontaminate.align(items.words[k], words[max(s - d, 0) : s + 8 + d])[0] > d
    assert not ok.all()


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 300, 3000)
    m = WaveletMatrix.loads(WaveletMatrix.build(ids, 9).dumps())
    assert (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 513, 2999):
        assert m.access(i) == ids[i]
        assert m.rank(7, i) == (ids[:i] == 7).sum()
    where = np.flatnonzero(ids == 7)
    assert m.count(7) == len(where) and [m.select(7, k) for k in range(len(where))] == where.tolist() and m.count(511) == 0
    assert len(WaveletMatrix.loads(WaveletMatrix.build(ids[:0], 9).dumps()).decode()) == 0


def test_tokens_equal_the_tokenizer(corpus, docs, empty, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    t, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: tuple(r)[1:] for r in token_output.read_tokens(token_output.write_tokens(docs, path, shard_tokens=500)).collect()}
    for i, text, *_ in sorted(corpus):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_output.read_tokens(token_output.write_tokens(empty, path)).count() == 0
    odd = ["It's <|endoftext|> ÀB, İstanbul...!! x", "<|ENDOFTEXT|>", "a\tb c d\x1ce 12,5 O'Neil's", "é Å ΣΑΣ.", "***a** b&&&, %%", "", None, " \n", "\u0301a <|startoftext|>b"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in odd]
    coder = token_output.Encoder(path)
    assert not coder.whole and [x.tolist() for x in coder.encode(odd)] == want
    monkeypatch.setattr(token_output, "CACHED_WORDS", 3)
    assert [x.tolist() for x in token_output.Encoder(path).encode(odd)] == want


def test_words_that_cross_blocks(monkeypatch):
    rng = random.Random(12)
    text = "".join(rng.choice(["a", "b", " ", "é", "\n", "Zx"]) for _ in range(5000)) + "y" * 3000 + " end"
    want, long = shingles_mod.word_hashes(text), shingles_mod.words_of([text, None, text])
    assert len(want) == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and len(set(want.tolist())) == len(set(re.findall(r"[^\x20\x09-\x0D]+", text.lower())))
    for block in (1 << 10, 777, 64):
        monkeypatch.setattr(shingles_mod, "BLOCK", block)
        assert (shingles_mod.word_hashes(text) == want).all()
        assert all((x == y).all() for x, y in zip(shingles_mod.words_of([text, None, text]), long, strict=True))


def test_long_texts_in_bounded_memory():
    """40 MB of words: what the helpers keep afterwards does not depend on it, and scoring takes few times the text."""
    import tracemalloc

    text = "word " * 2_000_000 + "x" * 3_000_000
    p = quality.fresh()
    tracemalloc.start()
    shingles_mod.word_hashes(text)
    decontaminate.plain_words([text])
    quality.scores(p, [text])
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 30e6 and peak < 60 * len(text)


def test_quality_learns_on_held_out_rows(spark, empty):
    rng = random.Random(6)
    rows = [(i, (prose(rng, 150) if i % 2 else " ".join(w + "***" for w in prose(rng, 150).split())) if i % 50 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [r for r in got if r.held_out and r.doc_id % 50]
    assert sum(r.predicted == r.doc_id % 2 for r in test) / len(test) > 0.95
    assert quality.classify(empty, labels).count() == 0 and quality.classify(docs, labels.limit(0)).where("predicted = 0").count() == 0


def test_pipeline_keeps_columns(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and set(got.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    folder, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(None if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert len(got) > 0 and rows(got) == rows(want)
