import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import accumulate, permutations

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kgspark.llm import filter_audit, queries, sharding, token_alignment

A, B = (str(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, pair string, row string, links string"
ODD = [
    None, "", " ", "  a", "a  b \n c", "\n\n x", "héllo  wörld 😀\n\nok x", "a▁b", "<s> </s><unk> <|endoftext|> <0x0A>", "日本語 テキスト👨‍👩‍👧", "\x00 \x01", "a b 　 c", "x\t y\r\n  z   ",
    "ﬁ İ ſ", "é", "𝔘𝔫𝔦", "  a \u0085 b", "don't I'LL 've  's", " lead", "trail ", "same words", "same words", "ê" * 3000 + " end", "word " * 3000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    signs = ["the", "Großstadt", "nière", "£5", "x9", "Ω", "👍🏽", "\n", "the,", "ab-c", "…", "了"]
    return ODD + [" ".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(30)]


def tokens(both, text):
    """Of a text as one: ids, the ends of their bytes, links, groups; nothing if the bytes are not the text's."""
    if not text:
        return None
    ids = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = [both.bytes_a[i] for i in ids[0]], [both.bytes_b[i] for i in ids[1]]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    spans = [list(zip([0, *ends], ends)) for ends in (list(accumulate(map(len, r))) for r in raw)]
    links = [(i, j) for i, x in zip(ids[0], spans[0]) for j, y in zip(ids[1], spans[1]) if x[0] < y[1] and y[0] < x[1]] if len(ids[0]) < 500 else None
    cut = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
    inside = lambda k, low, high: ",".join(str(i) for i, (_, y) in zip(ids[k], spans[k]) if low < y <= high)
    groups = [f"{inside(0, low, high)}|{inside(1, low, high)}" for low, high in zip([0, *cut], cut)] if links else None
    return len(ids[0]), len(ids[1]), cut, links, groups


def test_alignment_equals_whole_texts(spark, texts):
    rows = [(i, t, None, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "the x9", "", "", "", ""), (0, "the x9", "", "", "", "")]
    got = sorted(token_alignment.link_strengths(spark.createDataFrame(rows, DOCS).repartition(3), A, B).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_a))
    both = token_alignment.Aligner(A, B)
    assert both.parts
    want = {i: tokens(both, t) for i, t in enumerate(texts)}
    shown = {i: w for i, w in want.items() if w and w[3] is not None}
    held = Counter(p for w in shown.values() for p in set(w[3]))
    for i in (1, 2):
        held.update(set(tokens(both, "the x9")[3]))
    for text in ("word " * 3000, "ê" * 3000 + " end"):  # too long to look at pair by pair
        k = both.documents([text])[2][0][0]
        held.update((int(p) // both.size_b, int(p) % both.size_b) for p in k)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id] if r.doc_id is not None and not (r.doc_id == 0 and r.n_a) else tokens(both, "the x9")
        if w is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        assert (r.n_a, r.n_b, r.n_groups) == (w[0], w[1], len(w[2]))
        if w[3] is not None:
            assert (r.n_links, r.n_best, r.count_sum) == (len(w[3]), sum(held[p] == best[p[0]] for p in w[3]), sum(held[p] for p in w[3]))
            assert r.groups_sha256 == hashlib.sha256(";".join(w[4]).encode()).hexdigest()


def test_alignment_of_whole_texts_word_by_word(texts):
    """The same groups and links whether the text is cut at its words or not, and in a table that is begun anew."""
    both, whole = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    whole.parts = False
    for t in texts:
        x, y = both.documents([t]), whole.documents([t])
        assert (x[0].tolist(), x[1], x[2][0][0].tolist(), x[2][0][1].tolist()) == (y[0].tolist(), y[1], y[2][0][0].tolist(), y[2][0][1].tolist())
        both.clear()


def test_alignment_of_nothing_and_its_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.link_strengths(empty, A, B).count() == 0
    rows = token_alignment.alignments(spark.createDataFrame([(1, "héllo 😀"), (2, None)], empty.schema), A, B).collect()
    assert [hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows if r.n_a] == [True]
    assert {r.doc_id: (r.groups, r.links) for r in rows}[2] == ("", [])


def test_beyond_the_broadcast_pairs_are_joined(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    want = sorted(map(tuple, token_alignment.link_strengths(docs, A, B).collect()))
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 1)
    assert sorted(map(tuple, token_alignment.link_strengths(docs, A, B).collect())) == want


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_sampled_splitters"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert len(got) == len(want) > 0
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)


def fails(rows):
    """The letters of each row's failed filters, one text at a time."""
    out = []
    for i, text, *_ in rows:
        text = text or ""
        w = [x for x in re.split(r"[ \t-\r]+", text) if x]
        checks = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))]
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        out.append({f for f, bad in zip("ABCDE", [*checks, copy], strict=True) if bad})
    return out


def test_audit_equals_filters_one_after_another(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(120))
    kinds = [None, "", "short", long, long, "A " * 130, long + " #", long.upper(), "x" * 5000, "a b " * 80, long + "\u00a0&"]
    rows = [(i if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(kinds), rng.choice([None, "", "en", "de"]), "p", "r", "l") for i in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.interactions(docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    failing = fails(rows)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    want, value = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in failing[k]]
                alive = [k for k in alive if f not in failing[k]]
                fell = [k for k in own if f in failing[k]]
                value[part, f] += len(gone)
                want[part, "".join(order), step] = (
                    len(alive), len(gone), len(fell) - len(gone), sum(failing[k] == {f} for k in own), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)
                )
    want = {k: (*v, value[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert got == want
    assert filter_audit.interactions(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    left = sorted(str(r.doc_id) for r in filter_audit.survivors(docs, "BED").collect())
    assert left == sorted(str(r[0]) for r, f in zip(rows, failing, strict=True) if not f & set("BED"))
    ids = filter_audit.failing_ids(filter_audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {f: df.count() for f, df in ids.items()} == {f: sum(f in x for x in failing) for f in "ABCDE"}


def check_shards(rows, got, n):
    """Each row once, slots without gaps, sizes and hashes right; returns size and number of rows by shard."""
    kinds = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == kinds
    slots, sizes = {}, Counter()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
        assert 0 <= r.shard < n and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes, {k: len(v) for k, v in slots.items()}


def test_shards_are_even_and_keep_small_groups(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(700)]
    rows = [(i, t, "", "", "", "") for i, t in enumerate(texts + texts[:60] * 2 + ["hot"] * 400 + [None, "", "x" * 3000])]
    rows += [(7, "same row", "", "", "", "")] * 300 + [(None, "no id", "", "", "", "")] * 5
    rng.shuffle(rows)
    monkeypatch.setattr(sharding, "GROUP_PARTS", 10)
    docs, n = spark.createDataFrame(rows, DOCS), 8
    got = sharding.shards(docs.repartition(5), n).collect()
    sizes, _ = check_shards(rows, got, n)
    mean = sum(sizes.values()) / n
    assert all(abs(v - mean) <= 3100 / 2 + mean / 5 for v in sizes.values())
    by_text, held = {}, Counter()
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
        held[r.text_crc32] += r.size
    assert all(len(by_text[k]) == 1 for k, v in held.items() if v <= mean / 10)
    assert len(by_text[zlib.crc32(b"hot")]) > 1  # 400 copies of one text are more than a shard's share of a tenth
    again = sharding.shards(docs.repartition(2), n).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    _, counts = check_shards(rows, sharding.shards(docs, n, "rows").collect(), n)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sharding.shards(docs.limit(0)).count() == 0
    few = sharding.shards(spark.createDataFrame(rows[:3], DOCS)).collect()
    check_shards(rows[:3], few, 40)


def test_an_overfull_range_is_divided(spark):
    rows = [(i, f"text {i}") for i in range(200)] + [(5, "text 5")] * 3000
    m = sharding.staged(sharding.measured(spark.createDataFrame(rows, "doc_id long, text string")), "m").withColumn("weight", F.col("size"))
    total = m.agg(F.sum("weight")).first()[0]
    got = sharding.divided(sharding.ranged(m, sharding.splitters(m, 50, total)), total / 50)
    cells = got.groupBy("range", "sub").agg(F.sum("weight").alias("w"), F.count_distinct("key").alias("keys")).collect()
    assert max(c.w for c in cells) < 5 * total / 50 and len({c.range for c in cells}) < len(cells)


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 7}", "en", "p", "r", None) for i in range(60)] + [(None, None, None, None, None, None)], DOCS)
    path = sharding.write_shards(docs, 4, path=f"file://{tmp_path}/out")
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    want = Counter((r.doc_id, r.shard) for r in sharding.shards(docs, 4).collect())
    assert Counter((r.doc_id, r.shard_) for r in back.collect()) == want
