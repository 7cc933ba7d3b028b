"""Operators for training data: edge cases, brute-force comparisons, planted cases."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitegrid.llm import common, graph_ann, line_dedup, ngram_jaccard, packing, piece_codec, pii, quality_rules, queries, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOREM = "the quick brown fox jumps over a lazy dog while seven wizards brew quiet jazz potions near old stone bridges every foggy autumn evening"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumn("hits", F.lit(1)).withColumn("ln", F.lit("x")).withColumn("root", F.lit(2)) if extra else df


def rand_words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empties, blanks, repeats, ties, a very long text and a null id, with extra columns of clashing names."""
    rng = random.Random(3)
    body = " ".join(rand_words(rng, 120))
    texts = [(1, None), (2, ""), (3, " \t\n\r "), (4, body), (5, body), (5, body), (6, body + " tail"), (7, "one"), (8, "\n".join([LOREM] * 4)), (None, body), (None, None), (9, " ".join(rand_words(rng, 30_000))), (10, "x" * 50_000), (11, LOREM)]
    return make(spark, texts, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_odd_rows_never_fail(spark, odd_docs, empty):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, empty):
        n = docs.count()
        assert quality_rules.judge(docs).count() == n
        assert piece_codec.encode_documents(docs).count() == n
        assert toxicity.toxic_scores(docs, labels).count() == n
        assert packing.pack(docs).select("doc_id").count() >= n
        assert pii.find_pii(docs).count() == n
        assert line_dedup.summary(docs).count() == n
        assert ngram_jaccard.join(docs).count() == n
        assert substring_dedup.dedup(docs).count() == n


def test_values_of_odd_rows(spark, odd_docs):
    """Nulls, empty and very long texts, ties and repeated rows have the results that the docstrings state."""
    empty_sha = hashlib.sha256(b"").hexdigest()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    got = {}
    for r in quality_rules.judge(odd_docs).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_dup_lines, r.base_failed, r.kept))
    assert got[1] == got[2] == got[3] == {(0, 0, True, False)} and got[9] == {(30_000, 0, False, True)}
    assert len(got[5]) == 1 and got[8] == {(4 * len(LOREM.split()), 3, True, False)} and len(got[None]) == 2
    codec = {(r.doc_id, r.n_tokens > 0, r.round_trip) for r in piece_codec.encode_documents(odd_docs).collect()}
    assert {(1, False, True), (2, False, True), (9, True, True), (10, True, True)} <= codec
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for r in toxicity.toxic_scores(odd_docs, labels).collect():
        assert 0 <= r.score <= 1 and (r.held_out is None) == (r.doc_id is None)
        assert r.doc_id not in (1, 2, 3) or (r.score, r.predicted) == (0.0, 0)
    packed = packing.pack(odd_docs).collect()
    check_packing(packed, 2048)
    one = zlib.crc32(np.array([0], "<u4").tobytes())
    assert [(r.piece, r.start, r.length, r.ids_crc32) for r in packed if r.doc_id in (1, 2)] == [(0, 0, 1, one)] * 2
    by_doc = Counter(r.doc_id for r in packed)
    assert by_doc[5] == 2 and by_doc[None] == 2 and by_doc[9] > 10
    pieces = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 9)
    assert all(p[1] == 2048 * p[0] for p in pieces) and all(p[2] == 2048 for p in pieces[:-1])
    for r in pii.find_pii(odd_docs).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) == (0, 0, 0, 0, empty_sha, "")
    lines = {}
    for r in line_dedup.dedup(odd_docs).collect():
        lines.setdefault(r.doc_id, []).append(r.text)
    assert lines[1] == [None] and lines[2] == [""] and lines[3] == [texts[3]] and lines[4] == [texts[4]] and lines[10] == [texts[10]]
    assert lines[5] == ["", ""] and lines[6] == [""] and lines[8] == [LOREM] and lines[11] == [""] and sorted(map(str, lines[None])) == sorted(["None", texts[4]])
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join(odd_docs).collect() if r.doc_id is not None}
    assert near[1] == (0, 1) and near[3] == (0, 3) and near[7] == (1, 7) and {near[k][1] for k in (4, 5, 6)} == {4} and near[9][1] == 9
    kept = {}
    for r in substring_dedup.dedup(odd_docs).collect():
        kept.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed))
    assert kept[1] == kept[2] == kept[3] == {(0, 0)} and kept[4] == {(120, 0)} and kept[5] == {(120, 120)} and kept[6] == {(121, 120)} and kept[9] == {(30_000, 0)} and kept[None] == {(120, 0), (0, 0)}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage of the pipeline on its predecessor's rows, with plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(17)
    base = rand_words(rng, 90, 4000)
    texts = {}
    for i in range(100):
        w = rand_words(rng, rng.randrange(12, 60), 4000) + ([rng.choice(["zorgish", "zorgan"]), "x."] if i % 4 == 0 else [])
        if i % 10 == 3:
            w = [*base[:-2], f"e{i}", f"f{i}"]
        text = " ".join(w) + rng.choice(["", f" mail a{i}@b.org", " call +1 415 555 0123", " john at b dot com"])
        texts[i] = text + (f"\n{LOREM} {i % 3}\nown line number {i} here" if i % 5 == 0 else "")
    texts |= {100: None, 101: ""}
    sf = str(tmp_path / "sf")
    make(spark, list(texts.items())).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = common.table(spark, sf, "documents")
    (_, toxic), (_, lines), (_, near), (_, private), (_, pack) = corpus_pipeline.STAGES
    bad = {r.doc_id for r in toxicity.toxic_scores(docs, common.table(spark, sf, "labels")).collect() if r.predicted}
    out = common.stored(toxic(spark, docs, sf))
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept == {i: t for i, t in texts.items() if i not in bad} and bad >= {i for i in range(0, 100, 4)} and len(bad) <= 27
    out = common.stored(lines(spark, out, sf))
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    want = brute_lines(kept)
    assert rows == {i: (t, len(t) if t is not None else None) for i, t in want.items()}
    out = common.stored(near(spark, out, sf))
    firsts = {i for i, (_, root) in brute_components(want).items() if root == i}
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in want.items() if i in firsts}
    out = common.stored(private(spark, out, sf))
    masked = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert masked == {i: (pii.masked(want[i]), len(pii.masked(want[i])) if want[i] is not None else None) for i in firsts}
    assert not any(re.search(BASE["email"], t or "") or "415 555" in (t or "") or "john at" in (t or "") for t, _ in masked.values())
    packed = pack(spark, out, sf).collect()
    check_packing(packed, 2048)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.ids_crc32) for r in packed) == sorted((i, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, (t, _) in masked.items())
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name


def test_stages_keep_columns(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (toxicity.drop_toxic(odd_docs, labels), line_dedup.dedup(odd_docs), ngram_jaccard.first_of_each(odd_docs), pii.mask(odd_docs)):
        assert out.columns == odd_docs.columns
        out.count()


def test_whole_queries_against_sql(spark, sf, duck):
    made, sql = queries.queries(), queries.oracle_sql()
    for name, text in sql.items():
        assert oracle.difference(made[name](spark, sf), text, duck) == "", name


# 1


def test_ledger_policies_and_ablation(spark):
    docs = make(spark, [(1, "word " * 3), (2, " ".join(rand_words(random.Random(1), 60, 9000))), (3, ("%% $$ " + LOREM + " ") * 1 + "### " * 30), (4, "A B C D E F G H I J K L ! ! ! ! !")])
    rows = quality_rules.ledger(docs)
    kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(rows, quality_rules.FULL).collect()}
    assert kept == {1: False, 2: True, 3: False, 4: False}
    ab = {r.rule: r for r in quality_rules.ablations(rows, quality_rules.FULL).collect()}
    bits = [r.fail_bits for r in rows.collect()]
    for k, rule in enumerate(quality_rules.RULES):
        rest = quality_rules.FULL.mask & ~(1 << k)
        assert (ab[rule].n_failed, ab[rule].n_kept_without) == (sum(b >> k & 1 for b in bits), sum(b & rest == 0 for b in bits))


def test_repeat_words_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        w = [rng.choice("abc").encode() for _ in range(rng.randrange(40))]
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        want = {p for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        assert quality_rules.repeat_words(w) == len(want)


# 2


def test_pieces_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.Codec(path)
    rng = random.Random(1)
    texts = ["", " ", "   ", "a  b", "▁x ▁▁y", "日本語 😀 é", "<s> <0x0A> <unk>", "\x00 a\x00", "    def f():\n\t\treturn  1", "a" * 3000, LOREM, " " * 45 + "z"]
    texts += ["".join(rng.choice("etaoin shrdlu  \n.,é日=") for _ in range(120)) for _ in range(300)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        want = sp.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert codec.decode(ids) == sp.decode(want), t


def test_piece_memory_is_bounded():
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"), limit=50)
    texts = [" ".join(f"w{i * 7 + k}" for k in range(30)) for i in range(20)]
    fresh = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert [x for t in texts for x in codec.encode([t])] == list(fresh.encode(texts))


def test_full_piece_memory_keeps_what_is_needed(monkeypatch):
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"), limit=50)
    learnt, learn = [], codec.learn
    monkeypatch.setattr(codec, "learn", lambda new: (learnt.append(len(new)), learn(new)))
    first, second = (" ".join(f"w{k}" for k in range(a, a + 40)) for a in (0, 20))
    want = list(piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model")).encode([first, second]))
    assert [x for t in (first, second) for x in codec.encode([t])] == want
    assert learnt == [40, 20] and len(codec.memory) == 40


# 3


def test_noisy_or_finds_the_sentence():
    rng = random.Random(8)
    bad = ["zorgish", "zorgan", "zorgel"]
    texts, labels = [], []
    for i in range(400):
        sents = [" ".join(rand_words(rng, 8)) + "." for _ in range(6)]
        y = int(i % 5 == 0)
        if y:
            sents[2] = " ".join([*rand_words(rng, 3), rng.choice(bad), *rand_words(rng, 4)]) + "."
        texts.append(" ".join(sents).encode())
        labels.append(y)
    model = toxicity.fit(texts[:300], labels[:300])
    score = model.scorer()
    got = [int(score(t)[0] >= 0.3) for t in texts[300:]]
    assert got == labels[300:]
    p, z, starts = score(b"w4 w5 w6. w7 zorgiful w8. w9 w1 w2.")
    assert p >= 0.3 and int(np.argmax(z)) == 1 and starts.tolist() == [0, 3, 6]
    assert score(None)[0] == 0.0 and toxicity.fit([b"a"], [0]).scorer()(b"a b")[0] < 1e-9


def test_noisy_or_and_the_fit(spark):
    """1 - prod(1 - p) over sentences; and no small step of the weights or the bias raises the bags' likelihood much."""
    rng = random.Random(4)
    texts = [" ".join([*rand_words(rng, 9, 40), *(["badword"] if i % 3 == 0 else []), "end.", *rand_words(rng, 5, 40)]).encode() for i in range(240)]
    labels = [int(i % 3 == 0) if i % 10 else int(i % 3 != 0) for i in range(240)]  # some labels are wrong, so weights stay finite
    model = toxicity.fit(texts, labels, steps=3000, rate=0.05)
    score = model.scorer()
    for t in texts[:50]:
        p, z, _ = score(t)
        assert p == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))), abs=1e-12)

    def loss(m):
        p = np.clip([m.scorer()(t)[0] for t in texts], 1e-12, 1 - 1e-12)
        return -np.mean(np.where(np.array(labels) > 0, np.log(p), np.log(1 - p)))

    assert model.weights
    for name in [*model.weights, None]:
        moved = lambda d: toxicity.Model({k: v + d * (k == name) for k, v in model.weights.items()}, model.bias + d * (name is None))  # noqa: E731, B023
        assert abs(loss(moved(1e-4)) - loss(moved(-1e-4))) / 2e-4 < 2e-3, name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.toxic_scores(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    rows = out.join(common.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) > 0
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in out.collect())


# 4


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_layout_and_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = {i: " ".join(rand_words(rng, rng.choice([3, 40, 200, 900]))) + " don't ÉTÉ 3.5 <|endoftext|>" for i in range(60)}
    texts[60], texts[61] = "", None
    rows = packing.pack(make(spark, list(texts.items())), shard_pieces=40).collect()
    n = check_packing(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 4
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for a in range(0, len(ids), 2048) for p in [ids[a : a + 2048]]]


def test_local_search_never_hurts_and_empties_bins():
    rng = random.Random(6)
    better = 0
    for _ in range(60):
        sizes = [rng.randrange(1, 60) if rng.random() < 0.3 else rng.randrange(25, 75) for _ in range(80)]
        start = [[i] for i in range(80)] if rng.random() < 0.5 else [[i, i + 40] if sizes[i] + sizes[i + 40] <= 100 else [i] for i in range(40)]
        start += [[i] for i in set(range(80)) - {i for b in start for i in b}]
        end = packing.improve([list(b) for b in start], sizes, 100)
        assert sorted(itertools.chain(*end)) == list(range(80)) and all(sum(sizes[i] for i in b) <= 100 for b in end)
        square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)  # noqa: E731, B023
        assert len(end) <= len(start) and (square(end) > square(start) or sorted(map(sorted, end)) == sorted(map(sorted, start)))
        better += len(end) < len(start)
    # first fit in the given order leaves more to gain
    sizes = [rng.randrange(20, 70) for _ in range(200)]
    naive = [[i] for i in range(200)]
    assert len(packing.improve(naive, sizes, 100)) <= -(-sum(sizes) // 100) + 12


def test_two_for_one_empties_bins():
    """Single pieces to start with, as pack_pieces has them: two pieces from two sequences must be able to come."""
    for sizes, n in (([40, 18, 18, 53, 42, 74, 19, 27], 3), ([48, 23, 56, 35, 21, 63, 34, 16, 34, 55], 4)):
        single = [[i] for i in range(len(sizes))]
        first = packing._pass(single, sizes, 100, False)
        end = packing.improve(single, sizes, 100)
        assert len(end) == n < len(first) and sorted(itertools.chain(*end)) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in end)


def test_workers_forget_for_other_operators():
    """A worker that packed doesn't hold its chunks while it serves another operator, but does for its own next task."""
    list(packing.encoder(public_tokenizers.path(packing.VOCABULARY))([b"some words"]))
    common.tidy("packing")
    assert packing._known_chunks.cache_info().currsize == 1
    common.tidy()
    assert packing._known_chunks.cache_info().currsize == 0


def test_search_reaches_the_bound_on_documents(spark):
    rows = packing.pack(common.table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert check_packing(rows, 2048) == -(-sum(r.length for r in rows) // 2048)


# 5


def test_urls(spark):
    urls = [None, "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q", "http://example.org/en/1", "http://xexample.org/es/", "http://b.com/fr/#f", "http://b.com?/fr/", "http://x.com/de/y", "http://m.cheap-pills.net/a", "http://org/", "http://a.org", "ftp://É.org/ß", "x://a.com/fr/://b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in sorted(url_filter.judge(df).collect())]
    assert got[:6] == [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"), ("xexample.org", "/es/", "org/", "allow")]
    assert got[6:] == [("b.com", "/fr/", "com/fr/", "allow"), ("b.com", "", None, "allow"), ("x.com", "/de/y", "com/de/", "block"), ("m.cheap-pills.net", "/a", None, "block"), ("org", "/", "org/", "allow"), ("a.org", "", None, "allow"), ("É.org", "/ß", "org/", "allow"), ("a.com", "/fr/://b", "com/fr/", "allow")]
    assert url_filter.judge(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judge(df, spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "label string")).collect()} == {"allow"}
    # repeated rows are judged one by one, and a list may repeat its keys
    twice = spark.createDataFrame([("a.org", "/x", "allow"), ("a.org", "/x", "block"), (None, "/", "block")], "host string, path string, verdict string")
    again = df.where("page_id = 11").unionByName(df.where("page_id = 10")).unionByName(spark.createDataFrame([(99, "http://b.a.org/xy", "c")] * 2, df.schema))
    assert sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge(again, twice).collect()) == [(10, None, "allow"), (11, None, "allow"), (99, "a.org/x", "block"), (99, "a.org/x", "block")]


def test_a_million_keys_in_ranges(spark):
    """The index is built by Spark in ranges; all urls of the list are found, others aren't."""
    rules = spark.range(1_000_000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    ids = [0, 1, 77, 999_999, 1_000_000, 5_000_000]
    df = spark.createDataFrame([(i, f"http://www.h{i}.net/a") for i in ids], "page_id long, url string")
    names = url_filter.DigestIndex.ship(rules.select(F.concat("host", "path").alias("key"), F.lit(1).alias("value")), 300_000)
    assert len(names) == 4
    index = url_filter.DigestIndex.opened(names)
    assert [len(r["digests"]) > 100_000 for r in index.ranges] == [True] * 4
    assert [v >= 0 for v in index.find([f"h{i}.net/" for i in range(0, 1_000_100, 9973)])] == [i < 1_000_000 for i in range(0, 1_000_100, 9973)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got == {i: (f"h{i}.net/", "block" if i % 2 == 0 else "allow") if i < 1_000_000 else (None, "allow") for i in ids}


def test_colliding_digests_are_confirmed():
    weak = lambda k: len(k) % 3
    index = url_filter.DigestIndex([url_filter.DigestIndex.arrays(sorted((weak(w), w, 1) for w in set(LOREM.split())))])
    words = [*LOREM.split(), "nope", "xyz", ""]
    assert [v >= 0 for v in index.find(words, hashed=weak)] == [w in set(LOREM.split()) for w in words]


# 6

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_base_detectors_equal_the_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        t = "".join(rng.choice("0140.@+- ab()%25") for _ in range(rng.randrange(70)))
        for kind, p in BASE.items():
            assert pii.DETECTORS[kind](t) == [m.span() for m in re.finditer(p, t) if passes(kind, m.group())], t


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("é mail john.doe [at] mail5 dot example dot com now", "email", "john.doe [at] mail5 dot example dot com"), ("x аbс@exаmple.com y", "email", "аbс@exаmple.com"),
        ("ｆｏｏ＠ｂａｒ．ｃｏｍ", "email", "ｆｏｏ＠ｂａｒ．ｃｏｍ"), ("john(at)example(dot)com", "email", "john(at)example(dot)com"), ("foo at bar dot com", "email", "foo at bar dot com"),
        ("tel plus one 415 555 zero one two three ok", "phone", "plus one 415 555 zero one two three"), ("ip 10 dot 20 dot 30 dot 40.", "ip", "10 dot 20 dot 30 dot 40"),
        ("four one one one 1111 1111 1111 end", "card", "four one one one 1111 1111 1111"), ("10[.]0[.]0[.]1 x", "ip", "10[.]0[.]0[.]1"),
    ],
)
def test_disguises_map_back(text, kind, part):
    base, added = pii.spans(text)
    assert [(text[a:b], k) for a, b, k in added] == [(part, kind)] or (text[added[0][0] : added[0][1]] if added else None) == part


def test_clean_text_and_long_runs():
    for t in ("look at example.com and one two three dots", "it was at the. One, two. Seven of nine", LOREM, "1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "@" * 50_000, "one " * 20_000):
        assert pii.spans(t)[1] == [] or t.startswith("one ")


def test_far_mailbox_and_long_disguises():
    far = "bob.x" + "y" * 200_000 + " at mail.com"
    assert [far[a:b] for a, b, _ in pii.spans(far)[1]] == [far]
    many = " ".join(f"user{i} at mail{i} dot org," for i in range(9_000))
    base, added = pii.spans(many)
    assert not base and len(added) == 9_000 and len(many) > 200_000
    for t in ("a-at-" * 40_000, "x_at_" * 40_000, " " * 200_000 + "[at]", "at" + "-" * 200_000 + " at " + "-" * 1000, "1 . " * 50_000, "a [at] " * 30_000, "one " * 50_000):
        began = time.perf_counter()
        pii.spans(t)
        assert time.perf_counter() - began < 10, t[:20]


def test_masked():
    assert pii.masked("mail a.b@c.de or +1 (415) 555-1234.") == "mail <EMAIL> or <PHONE>."
    assert pii.masked(None) is None and pii.masked("") == ""


# 7


def brute_lines(texts, percent=80):
    lines = [(i, k, frozenset(WORD.findall(x)), x) for i, t in sorted(texts.items()) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    gone = set()
    for n, (i, k, s, _) in enumerate(lines):
        if any(100 * len(s & o) >= percent * len(s | o) for *_, o, _ in lines[:n]):
            gone.add((i, k))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None for i, t in texts.items()}


def test_lines_against_brute_force(spark):
    rng = random.Random(12)
    pool = [rand_words(rng, rng.randrange(1, 14), 60) for _ in range(25)]

    def line():
        w = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(30)}"
        return rng.choice([" ", "\t", "  "]).join(w) if rng.random() < 0.95 else rng.choice(["", "  "])

    texts = {i: "\n".join(line() for _ in range(rng.randrange(1, 9))) for i in range(60)}
    texts[60], texts[61] = None, ""
    got = {r.doc_id: r.text for r in line_dedup.dedup(make(spark, list(texts.items()), extra=True)).collect()}
    assert got == brute_lines(texts)


# 8


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:760] = x[700]  # a large group of equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0] * 15 + [None], 0), (5400, [1.0, 2.0], 0), (5401, [1.0, 3.0], 0), (100, x[100].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in graph_ann.nearest(df, df.where("vec_id % 100 = 0"), shard_vectors=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {*range(0, 1500, 100), 5400} and sorted(got[5400]) == [(1, 5401, 1.0)]
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hit >= 0.9 * 150
    assert [v for _, v, _ in sorted(got[700])] == list(range(701, 711))
    assert graph_ann.nearest(df.where("false"), df).count() == 0


# 9


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
        break
    return {i: (len(sets[i]), root[i]) for i in sets}


def near_texts(rng, n_groups=10, size=9):
    texts, k = {}, 0
    for _ in range(n_groups):
        base = rand_words(rng, rng.randrange(3, 130), 3000)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts[k] = " ".join(w)
            k += 1
    return texts


@pytest.mark.parametrize(("most", "cluster"), [(24, 3_000_000), (2, 3_000_000), (3, 300)])
def test_components_against_brute_force(spark, most, cluster):
    rng = random.Random(21)
    texts = near_texts(rng)
    passage = " ".join(rand_words(rng, 60, 5000))
    for k in range(200, 230):
        texts[k] = " ".join(rand_words(rng, 12, 9000)) + " " + passage
    texts[300], texts[301], texts[302] = "", None, "Two words"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join(make(spark, list(texts.items())), most=most, cluster_shingles=cluster).collect()}
    assert got == brute_components(texts)


def test_a_strung_cluster_is_searched_again(spark):
    """A cluster over the bound falls apart into what its own documents link, instead of being copied block by block."""
    texts = near_texts(random.Random(4), n_groups=12, size=4)
    docs = make(spark, list(texts.items()))
    with common.Kept(spark) as keep:
        reps = ngram_jaccard._candidates(docs, 5, 80, 24, keep, keep)[1]
        strung = keep(reps.select("node", F.lit(0).cast("long").alias("root"), "h1", "h2", "least", "n"))
        rows = ngram_jaccard.narrowed(docs, strung, 5, 80, 24, 300, keep).collect()
    found, weight = {r.least: r.root for r in rows}, Counter()
    for r in rows:
        weight[r.root] += r.n
    assert sum(weight.values()) > 300 and max(weight.values()) < 4 * 130 and len(weight) > 4
    want = brute_components(texts)
    linked = [(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a][1] == want[b][1] and texts[a] != texts[b]]
    assert linked and all(found[a] == found[b] for a, b in linked if a in found and b in found)
    assert all(a in found and b in found for a, b in linked if want[a][0] and [texts[c] for c in sorted(texts) if c < b].count(texts[b]) == 0 and [texts[c] for c in sorted(texts) if c < a].count(texts[a]) == 0)


def test_sketch_counts_in_many_buckets(spark):
    """Enough buckets that frequent shingles stand out at gigabytes; counts come back from their levels."""
    passage = " ".join(rand_words(random.Random(8), 30, 9000))
    levels = ngram_jaccard.sketch(make(spark, [(i, f"{passage} own{i}") for i in range(300)]))
    assert len(levels) >= 1 << 22 and levels.dtype.itemsize == 2
    counts = np.sort(np.round(ngram_jaccard.counted(levels)))
    assert counts[-26:].min() >= 300 and counts.sum() == 300 * 27
    assert np.allclose(ngram_jaccard.counted(ngram_jaccard.level(np.array([0, 1, 70_000, 2**31]))), [0, 1, 70_000, 2**31], rtol=1e-3)


def test_repeated_ids_are_told_apart_by_their_texts(spark):
    rng = random.Random(5)
    a, b = rand_words(rng, 100, 5000), " ".join(rand_words(rng, 100, 5000))
    near = " ".join([*a[:99], "other"])
    docs = make(spark, [(1, " ".join(a)), (5, near), (5, b), (7, b), (7, b)], extra=True)
    assert sorted((r.doc_id, r.component_id) for r in ngram_jaccard.join(docs).collect()) == [(1, 1), (5, 1), (5, 5), (7, 5), (7, 5)]
    assert sorted((r.doc_id, r.text) for r in ngram_jaccard.first_of_each(docs).collect()) == sorted([(1, " ".join(a)), (5, b)])


# 10


def brute_windows(texts, width=50):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    low = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            low.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - width + 1) if low[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def window_texts(rng):
    passages = [rand_words(rng, rng.choice([49, 50, 51, 80, 160]), 4000) for _ in range(8)]
    texts = {i: " ".join(rand_words(rng, rng.randrange(40), 4000) + rng.choice(passages) + rand_words(rng, rng.randrange(40), 4000) + (rng.choice(passages) if i % 3 == 0 else [])) for i in range(80)}
    texts |= {90: "be " * 200, 91: "be " * 120, 92: None, 93: "", 94: texts[3], 95: "no be " * 80}
    return texts


def test_windows_against_brute_force(spark):
    texts = window_texts(random.Random(31))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(make(spark, list(texts.items()))).collect()}
    assert got == brute_windows(texts)


def test_hot_anchors_and_small_shards(spark):
    texts = window_texts(random.Random(32))
    docs = make(spark, list(texts.items()))
    plain = {(r.doc, tuple(sorted(set(r.hits)))) for r in substring_dedup.duplicate_windows(docs).collect()}
    for more in ({"hot_docs": 2}, {"shard_words": 200}):
        assert {(r.doc, tuple(sorted(set(r.hits)))) for r in substring_dedup.duplicate_windows(docs, **more).collect()} == plain


def test_wavelet_matrix_rank():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 37, 1000)
    w = substring_dedup.WaveletMatrix(v, 37)
    s, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert w.rank(s, at).tolist() == [int((v[:p] == c).sum()) for c, p in zip(s, at, strict=True)]


# shared


def test_bitmap_has_no_false_negatives(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    flags = common.flags(df.where("k % 7 = 0"), "k", 16, common.stored)
    hit = {r.k for r in df.where(common.maybe_in(flags, "k", 16)).collect()}
    assert set(range(0, 5000, 7)) <= hit and len(hit) < 1100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.stored).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 200: 200, 201: 200, 202: 200}


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, 2048)


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(str(d)).rglob("shuffle_*")}


def test_steps_leave_no_shuffle_files(spark):
    """A job's disk holds one query's shuffle at a time, whenever the driver collects its garbage; the switch is put back."""
    before, switch = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(switch)
    rows = common.stored(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    ngram_jaccard.sketch(make(spark, [(1, LOREM), (2, LOREM)]), bits=8)
    assert not shuffle_files(spark) - before and spark.conf.get(switch) == was
    assert rows.count() == 10


def test_components_keep_no_prefixes(spark):
    """What stays after op9's search is a few numbers a document, not the prefixes of its shingles."""
    rows = ngram_jaccard._joined(make(spark, [(1, LOREM), (2, LOREM + " x")]), 5, 80, 24, 300)
    assert "prefix" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_fit_holds_one_bag_at_a_time():
    """The fit's memory follows the words, not all words' features at once."""
    rng = random.Random(3)
    vocab = [f"word{i:05d}" for i in range(5000)]
    texts = [" ".join(["venom"] * (d % 2) + rng.choices(vocab, k=2000)).encode() for d in range(300)]
    tracemalloc.start()
    model = toxicity.fit(texts, [d % 2 for d in range(300)], steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "w:venom" in model.weights and peak < 12 * 300 * 2000


def test_a_task_tidies_when_it_ends(monkeypatch):
    seen = []
    monkeypatch.setitem(common.REMEMBERED, "other", lambda: seen.append("forgot"))
    run = common.tidied(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and seen == ["forgot", "forgot"]


def test_leaders_settle_a_group_of_near_copies(spark):
    """Most lines that resemble an earlier one are settled by a leader, though not every two of the group are similar."""
    rng = random.Random(8)
    base = [f"base{i}" for i in range(60)]
    texts = [(d, " ".join(f"own{d}x{i}" if rng.random() < 0.1 else w for i, w in enumerate(base))) for d in range(250)]
    docs = make(spark, texts)
    sets = [set(t.split()) for _, t in texts]
    alike = {b for a, b in itertools.combinations(range(250), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    with common.Kept(spark) as keep:
        first = line_dedup.first_lines(docs, 80, keep)
        led = keep(line_dedup.led_pairs(first, 80))
        assert led.count() == led.select("l_doc", "l_ln").distinct().count()
        settled = {r.doc_id for r in line_dedup.similar_later(docs, led, 80, keep).collect()}
        every = {r.doc_id for r in line_dedup.dominated_lines(docs, first, 80, keep).select("doc_id").collect()}
    assert every == alike and settled <= alike and len(settled) > 0.6 * len(alike) > 60


def test_line_joins_deal_their_rows_once(spark):
    """Leaders and those who meet them share one exchange, heads as both sides another; marks are exact, bitmap or not."""
    rng = random.Random(9)
    docs = make(spark, [(d, " ".join(rand_words(rng, 30, 60))) for d in range(60)])
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    dealt = lambda df: len(re.findall(r"- Exchange hashpartitioning\(key", df._jdf.queryExecution().executedPlan().toString()))
    with common.Kept(spark) as keep:
        first = line_dedup.first_lines(docs, 80, keep)
        settled = keep(first.where("doc_id % 3 = 0").select("doc_id", "ln"))
        try:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            assert dealt(line_dedup.led_pairs(first, 80)) == 1
            assert dealt(line_dedup.open_pairs(first, settled, 80, keep)) == 2
        finally:
            for k, v in held.items():
                spark.conf.set(k, v)
        marks = {r.doc_id: r.open for r in line_dedup.marked(first, settled, keep).collect()}
    assert marks == {d: int(d % 3 != 0) for d in range(60)}


def test_line_levels_are_counted_on_a_sample(spark):
    """Few lines give the levels, only wide lines pay for the wide signature, and no similar pair is missed by either."""
    rng = random.Random(10)
    sizes = range(line_dedup.WIDE - 8, line_dedup.WIDE + 9)
    texts = list(enumerate(" ".join(f"v{g}x{i}" for i in rng.sample(range(n + 5), n)) for g in range(3) for n in sizes))
    docs, sets = make(spark, texts), [set(t.split()) for _, t in texts]
    alike = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    with common.Kept(spark) as keep:
        own = make(spark, [(d, " ".join(f"own{d}x{i}" for i in range(5))) for d in range(100)])
        (levels,) = spark.range(1).select(line_dedup.bucket_levels(own, keep)).first()
        first = line_dedup.first_lines(docs, 80, keep)
        sizes_x = {(r.n > line_dedup.WIDE, r.x != 0) for r in first.collect()}
        pairs = {(r.e_doc, r.l_doc) for r in line_dedup.open_pairs(first, first.select("doc_id", "ln").where("false"), 80, keep).collect()}
    assert 0 < sum(v != 0 for v in levels) < 0.5 * 500
    assert sizes_x == {(False, False), (True, True)}
    assert alike <= pairs and len(alike) > 60


def test_packing_holds_as_many_chunks_as_it_may():
    """In a pipeline a worker knows fewer chunks and has fewer words in hand; the ids are the same."""
    path, rng = public_tokenizers.path(packing.VOCABULARY), random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh12", k=6)) for _ in range(900)).encode() for _ in range(20)]
    want = list(packing.encoder(path)(texts))
    common.tidy()
    got = []
    for ids in packing.encoder(path, 2000, 1000)(texts):
        got.append(ids)
        assert len(packing._known_chunks(path)) <= 2000
    common.tidy()
    assert got == want
