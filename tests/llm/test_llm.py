"""The training-data operators against libraries, brute force, round trips and edge rows."""

import hashlib
import io
import itertools
import wave
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipweave.llm import components, decontaminate, fitting, jaccard, language, media, packing, quality, queries, token_counts, token_files, toxicity, warc
from clipweave.llm.common import _PIECE, folded, pieces, without

ODD = [None, "", " ", "\n\n\t", "a", "Don't stop<|endoftext|>now", "x" * 5000, "naïve  café\r\n½ ² ٣ 漢字かな ไทย 😀 é", "  \u001c end", "a b c d e f g " * 300, "same text", "same text"]
WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ne", "sa", "ti") for b in ("r", "sten", "ling", "tor", "mi", "pa")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 4 else None, t, "x") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_plain_characters_split_as_the_library_splits_them(library):
    worker = pieces(queries.tokenizer())
    rng = Random(2)
    plain = [c for k in range(0x110000) if not 0xD800 <= k < 0xE000 and worker.plain(c := chr(k))]
    assert len(plain) > 20000
    for k in range(0, len(plain), 97):
        text = "".join(rng.choice((c, c, " ", "a", "1", "'s", "\n", "!")) for c in plain[k : k + 97])
        whole = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert _PIECE.findall(text) == whole


def test_token_counts(spark, odd, library):
    got = token_counts.token_counts(odd, queries.tokenizer(), entries=3).collect()
    assert len(got) == len(ODD)
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert token_counts.token_counts(odd.where("false"), queries.tokenizer()).count() == 0


def test_token_files_round_trip(spark, odd, library):
    folder = token_files.write_token_files(odd, queries.tokenizer())
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(ids) == len(ODD)
    text = {k if k != 4 else None: t for k, t in enumerate(ODD)}
    start = 0
    for r in rows:
        want = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == want
        start += len(want)
    index = token_files.read_index(spark, folder)
    some = token_files.read_records(index.orderBy(F.rand(1)).limit(5), folder).collect()
    by_id = {r.doc_id: bytes(r.ids) for r in rows if r.doc_id is not None}
    assert len(some) == 5 and all(r.doc_id is None or by_id[r.doc_id] == bytes(r.ids) for r in some)
    assert token_files.read_token_files(spark, token_files.write_token_files(odd.where("false"), queries.tokenizer())).count() == 0


def test_a_damaged_record_is_found():
    data = bytearray(token_files.framed(token_files.payload_of(7, np.arange(5, dtype="<u2"))))
    assert token_files.sequence_of(token_files.read_record(io.BytesIO(bytes(data))))[1].tolist() == [0, 1, 2, 3, 4]
    for k in (3, 20, len(data) - 1):
        bad = data.copy()
        bad[k] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_files.read_record(io.BytesIO(bytes(bad)))


def test_packing(spark, odd, library):
    rng = Random(4)
    more = spark.createDataFrame([(1000 + k, prose(rng, rng.choice((3, 40, 400, 3000))), "x") for k in range(120)], odd.schema).repartition(9)
    docs = odd.unionByName(more)
    rows = packing.pack(docs, queries.tokenizer()).collect()
    pieces_of, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces_of[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    text = {r.doc_id: r.text for r in docs.collect()}
    assert set(text) == set(pieces_of)
    for doc_id, parts in pieces_of.items():
        parts.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
        assert ids == library.encode(text[doc_id] or "", add_special_tokens=False).ids + [1] and all(r.doc_tokens == len(ids) for r in parts)
    total = sum(r.length for r in rows)
    sums = [sum(r.length for r in b) for b in bins.values()]
    assert sum(2048 - s for s in sums if s & (s - 1)) < 0.03 * total + 2048
    assert packing.pack(docs.where("false"), queries.tokenizer()).count() == 0


def test_cuts_fill_their_classes():
    for n in range(1, 9000, 7):
        got = list(packing.cuts(n, 2048))
        assert sum(size for size, _ in got) == n and all(size * k <= 2048 for size, k in got)


def test_media_round_trip(spark, odd):
    stored = media.store_media(odd)
    rows = {r.doc_id: r for r in media.media_features(stored).collect()}
    assert stored.count() == len(ODD)
    for k, text in enumerate(ODD):
        r = rows[k if k != 4 else None]
        data = (text or "").encode()
        assert r.n_bytes == len(data) and len(r.payload) % 192 == 0 and len(r.payload) > 0 and bytes(r.payload).startswith(data) and not bytes(r.payload)[len(data) :].strip(b" ")
        with wave.open(io.BytesIO(bytes(r.media))) as file:
            assert file.getsampwidth() == 1 and file.readframes(file.getnframes()) == bytes(r.payload)
        assert len(r.times) == len(r.codes) and r.times == sorted(r.times)
    assert rows[10].codes == rows[11].codes


def peaks_by_definition(samples):
    """Peaks from the plain sum of the transform, frame by frame, and their pairs from all peaks."""
    frame, hop, bands, width = media.FRAME, media.HOP, media.BANDS, media.FRAME // 2 // media.BANDS
    n = max(1, -(-max(0, len(samples) - frame) // hop) + 1)
    signal = np.zeros((n - 1) * hop + frame)
    signal[: len(samples)] = np.asarray(samples, float) - 128
    t = np.arange(frame)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (frame - 1))
    waves = np.exp(-2j * np.pi * np.outer(t, np.arange(1, frame // 2 + 1)) / frame)
    power = np.array([np.abs((signal[k * hop : k * hop + frame] * window) @ waves) for k in range(n)])
    peaks = []
    for k in range(n):
        for b in range(bands):
            own = power[:, b * width : (b + 1) * width]
            loud = own[k].max()
            if loud > 1 and (k == 0 or loud > own[k - 1].max()) and (k == n - 1 or loud >= own[k + 1].max()):
                peaks.append((k, int(own[k].argmax()) + b * width + 1))
    pairs = [(a[0], a[1] << 16 | b[1] << 8 | b[0] - a[0]) for k, a in enumerate(peaks) for b in peaks[k + 1 : k + 1 + media.AHEAD] if b[0] - a[0] <= media.REACH]
    return peaks, sorted(pairs)


def test_fingerprints_equal_their_definition(spark):
    rng = np.random.default_rng(3)
    tone = lambda hz, n: 128 + 90 * np.sin(2 * np.pi * hz * np.arange(n) / media.RATE)
    sounds = [np.concatenate([tone(hz, 900) for hz in (440, 1300, 2700, 3600, 300)]), np.full(500, 128), rng.integers(0, 256, 5000), np.frombuffer(b"The quick brown fox, again and again. " * 40, np.uint8), np.full(192, 32)]
    for samples in sounds:
        samples = np.round(samples).clip(0, 255).astype(np.uint8)
        at, freq = media.spectral_peaks(samples)
        peaks, pairs = peaks_by_definition(samples)
        assert list(zip(at.tolist(), freq.tolist())) == peaks
        times, codes = media.peak_pairs(at, freq)
        assert list(zip(times.tolist(), codes.tolist())) == pairs
    at, freq = media.spectral_peaks(np.round(tone(440, 4000)).astype(np.uint8))
    assert len(at) and abs(np.median(freq[freq < 24]) - 440 * media.FRAME / media.RATE) < 1
    docs = spark.createDataFrame([(1, "abc " * 300), (1, "abc " * 300), (None, ""), (2, None)], "doc_id long, text string")
    kept = media.store_fingerprints(media.media_features(media.store_media(docs))).collect()
    assert len(kept) == 4 and len({(tuple(r.times), tuple(r.codes)) for r in kept if r.doc_id == 1}) == 1


def test_quality_by_brute_force(spark, sf_dir):
    import zstandard

    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    size = lambda data, words: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words)).compress(data))
    w = model.logistic
    for r in quality.quality_scores(docs.where("doc_id % 9 = 0").union(docs.limit(1).withColumn("text", F.lit(None).cast("string"))), model).collect():
        data = (r.text or "").encode()
        blocks = [data[k : k + 1024] for k in range(0, max(1, len(data)), 1024)]
        good, bad = [size(b, model.good) for b in blocks], [size(b, model.bad) for b in blocks]
        each = [(b - g) / (b + g) for g, b in zip(good, bad)]
        x = [(sum(bad) - sum(good)) / (sum(bad) + sum(good)), (sum(good) - 12 * len(blocks)) / (len(data) + 1), min(each), max(each)]
        z = sum(c * (v - m) / s for c, v, m, s in zip(w.weights, x, w.mean, w.spread)) + w.weights[-1]
        assert abs(r.quality_score - 1 / (1 + np.exp(-z))) < 1e-9


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(k, "some text of words here " * (k + 1), "en") for k in range(6)] * 2, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    none = docs.where("false")
    for some in (docs, none):
        q = quality.fit_quality(some, labels if some is docs else labels.where("false"))
        t = toxicity.fit_toxicity(some, labels if some is docs else labels.where("false"))
        m = language.fit_language(some, chains=20, steps=2)
        for rows, n in ((docs, 12), (none, 0)):
            assert quality.quality_scores(rows, q).count() == toxicity.toxicity_scores(rows, t).count() == language.tag_languages(rows, m).count() == n
    assert media.media_features(media.store_media(none)).count() == 0 == decontaminate.contaminated(docs, none.withColumnRenamed("doc_id", "item_id")).count()
    found = decontaminate.contaminated(docs.withColumn("item_id", F.lit("old")), spark.createDataFrame([(7, "some text of words here some text of", "x")], "item_id long, text string, doc_id string"))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3, 4, 5] and found.where("n_hits < 1").count() == 0
    near = jaccard.near_duplicates(docs).collect()
    assert len(near) == 12 and all(a.component_id == b.component_id for a in near for b in near if a.doc_id == b.doc_id)
    tokens = token_files.read_token_files(spark, token_files.write_token_files(docs, queries.tokenizer())).collect()
    assert sorted(r.doc_id for r in tokens) == sorted([*range(6)] * 2)
    packed = packing.pack(docs, queries.tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("own")).collect()
    assert all(r.n == 2 * r.own for r in packed)


def test_archive(spark):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "u 1", long), (1, "u2", long), (2, None, long), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (8, "u8", "y" * 150), (None, "u9", "y" * 150), (1, "u2", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archive(spark, warc.write_archive(pages)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), *((k, "response", None) for k in (4, 5, 6, 7, 8, None))], key=str
    )
    text = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert bytes(r.payload) == text[r.page_id] and r.digest == hashlib.sha256(text[r.page_id]).hexdigest()
        head, _, content = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and len(content) == length + 4
    id_of = lambda head, name: head.decode().partition(f"\r\n{name}: ")[2].partition("\r\n")[0]
    ids = [id_of(bytes(r.record), "WARC-Record-ID") for r in got]
    assert len(set(ids)) == len(ids) == len(rows)
    responses = {id_of(bytes(r.record), "WARC-Record-ID") for r in got if r.record_type == "response"}
    assert all(id_of(bytes(r.record), "WARC-Refers-To") in responses for r in got if r.record_type == "revisit")
    same = spark.createDataFrame([(1, "u", "x", "2024-05-06T07:08:09Z", "old")] * 3 + [(None, "u", "x", "2025-05-06T07:08:09Z", "old")] * 2, "page_id long, url string, html string, crawled string, digest string")
    heads = [bytes(r.record) for r in warc.read_archive(spark, warc.write_archive(same, date=F.col("crawled"))).collect()]
    assert len({id_of(h, "WARC-Record-ID") for h in heads}) == 5 and sorted(id_of(h, "WARC-Date")[:4] for h in heads) == ["2024"] * 3 + ["2025"] * 2
    folder = warc.write_archive(pages)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    assert warc.read_archive(spark, warc.write_archive(pages.where("false"))).count() == 0


def brute_components(docs):
    sets = {}
    for doc_id, text in docs:
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys((9, 10, 11, 12, 13), " ")).split(" ") if w]
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {d: d for d in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), root(d)) for d in ids}


def family(rng, base, n):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("few", "blocks"), [((16, 48), {}), ((3, 5), {"block_docs": 8, "block_tokens": 2000}), ((1, 2), {})])
def test_near_duplicates_equal_brute_force(spark, blocks, few):
    rng = Random(5)
    texts = [None, "", " \t\n", "one", "One", "one two three four", "one two three four five"]
    passage = prose(rng, 60)
    texts += family(rng, prose(rng, 100), 70) + family(rng, prose(rng, 30), 20) + [t for _ in range(20) for t in family(rng, prose(rng, rng.randrange(6, 150)), 3)]
    texts += [f"{passage} {prose(rng, rng.randrange(1, 40))}" for _ in range(60)] + [prose(rng, 80)] * 9 + [passage.upper()]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in jaccard.near_duplicates(frame, few=few, **blocks).collect()}
    assert got == brute_components(docs)


def test_later_rounds_are_bounded_by_shingles_too(spark, monkeypatch):
    rng = Random(9)
    passage = prose(rng, 50)
    texts = family(rng, prose(rng, 100), 240) + [f"{passage} {prose(rng, 50)}" for _ in range(120)]
    groups, verified = [], jaccard._verified

    def counted(members, docs):
        groups.append(members.groupBy("grouped", "bin").count().agg(F.max("count")).head()[0])
        return verified(members, docs)

    monkeypatch.setattr(jaccard, "_verified", counted)
    docs = list(enumerate(texts))
    got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_tokens=1500, few=(3, 6)).collect()}
    assert got == brute_components(docs)
    # a group has some 15 of these documents; a block and those sent to it, twice as many
    assert len(groups) == 3 and groups[1] <= 35 and groups[2] <= 60, groups


def test_near_duplicates_of_odd_rows(spark, odd):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (10, 11)} == {10}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(odd.where("false")).count() == 0


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(3)
    hot = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    known = np.sort(hot)
    frequent = (known, np.arange(1, 401))
    few, all_ones = rng.integers(0, 1 << 63, jaccard.PLACES >> 6).astype(np.uint64), np.full(jaccard.PLACES >> 6, (1 << 64) - 1, np.uint64)
    for n in (1, 2, 3, 5, 8, 20, 60, 300):
        for share in (0.0, 0.5, 0.9, 1.0):
            for _ in range(20):
                a = np.unique(np.concatenate((rng.choice(hot, int(n * share), replace=False), rng.integers(1, 1 << 62, n - int(n * share)).astype(np.uint64))))
                lose = int(rng.integers(0, n - -(-80 * n // 100) + 1))
                b = np.unique(np.concatenate((rng.permutation(a)[lose:], rng.choice(hot, min(1, lose)))))
                both = len(np.intersect1d(a, b))
                if 100 * both < 80 * (len(a) + len(b) - both):
                    continue
                tokens, doc = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
                for bits in (None, few, all_ones) if len(a) > 1 else (None,):  # sets of one token link with equal sets only, and these are one
                    keys, of = jaccard.prefix_keys(tokens, doc, np.array([len(a), len(b)]), frequent, bits)
                    same = set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
                    assert len(same) > (jaccard.SPARE if bits is None and len(a) > jaccard.SPARE else 0)
                assert jaccard.may_link(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b))


def test_keys_of_many_sets_in_pieces():
    """Ties are complete whatever the pieces: sets of a key of many that are of like sizes are all in one star or chain."""
    rng = np.random.default_rng(4)
    keys = np.sort(rng.choice([5, 7, 7, 7, 7, 9], 900))
    labels, sizes = rng.integers(0, 400, 900), None
    size_of = rng.choice([10, 11, 13, 60, 70, 85, 500], 400)
    sizes = size_of[labels].astype(np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 40]) for x in (keys, labels, sizes)], names=["key", "label", "n"]) for k in range(0, 900, 40)]
    for piece in (1 << 16, 50):
        up = {}
        for batch in jaccard._paired(6, True, piece)(iter(batches)):
            for a, b, kind in zip(*(c.to_pylist() for c in batch.columns)):
                assert kind == jaccard.TIE
                up.setdefault(a, set()).add(b), up.setdefault(b, set()).add(a)
        for key in (5, 7, 9):
            own = sorted(set(labels[keys == key].tolist()), key=lambda x: size_of[x])
            for a, b in zip(own, own[1:]):
                if 100 * size_of[a] >= 80 * size_of[b]:
                    reached, todo = {a}, [a]
                    while todo:
                        todo += (new := up.get(todo.pop(), set()) - reached)
                        reached |= new
                    assert b in reached
        many = [r for batch in jaccard._paired(6, False, piece)(iter(batches)) for r in batch.to_pylist()]
        assert {(r["a"], r["kind"]) for r in many if r["kind"] == jaccard.MANY} == {(k, jaccard.MANY) for k in (5, 7, 9)}


def test_phrases_that_many_documents_share_do_not_tie_them(spark, monkeypatch):
    """Unlike documents of phrases that occur often each, with no frequent class: the work grows with the input, and no cluster arises."""
    rng, grown = Random(31), []
    verified = jaccard._verified

    def counted(members, docs):
        grown[-1] += members.count()
        return verified(members, docs)

    monkeypatch.setattr(jaccard, "_verified", counted)
    for n in (400, 1600):
        phrases = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(9999)}" for _ in range(9)) for _ in range(n * 12 // 40)]  # each in 40 documents
        docs = [(k, " ".join(rng.sample(phrases, 12))) for k in range(n)]
        grown.append(0)
        got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), few=(6, 12), most_frequent=0).collect()
        assert all(r.doc_id == r.component_id for r in got)
    assert grown[1] <= 6 * grown[0] + 40, grown


def test_components(spark):
    rng = Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}
    for a, b in pairs:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[a]:
                up[x] = up[a]
    assert got == {x: min(s) for x, s in up.items() if len(s) > 1}


def test_components_of_chains_hubs_and_odd_edges(spark):
    rng = Random(16)
    chain = rng.sample(range(10_000), 300)  # neighbours in no order, over many tasks
    pairs = [*zip(chain, chain[1:])] * 2 + [(20_000 + k, 20_500) for k in range(1000)] + [(7, 7), (None, 3), (3, None)]
    rng.shuffle(pairs)
    rows = components.connected(spark.createDataFrame(pairs, "a long, b long").repartition(9)).collect()
    assert len(rows) == 1300
    assert {r.node: r.component for r in rows} == dict.fromkeys(chain, min(chain)) | dict.fromkeys(range(20_000, 21_000), 20_000)
    assert components.connected(spark.createDataFrame([(7, 7), (None, 3)], "a long, b long")).collect() == []


def test_edges_are_tied_in_pieces():
    edges = [(k + 1, k) for k in range(50)]
    batches = [pa.RecordBatch.from_pylist([{"hi": a, "lo": b} for a, b in edges[k : k + 5]]) for k in range(0, 50, 5)]
    got = [b.to_pylist() for b in components._tied(batches, held=12)]
    assert [r for b in got for r in b] == [{"hi": k + 1, "lo": k - k % 15} for k in range(50)]
    assert [b.num_rows for b in components._tied([])] == [0]


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontamination(spark, most):
    rng = Random(7)
    items = [prose(rng, n) for n in (20, 45, 9, 4)]
    swapped = items[1].split()
    for k in (5, 14, 23, 36):
        swapped[k] = "other"
    docs = [items[0], "x " * 30 + items[0].upper().replace(" ", ", ") + " y" * 9, f"{prose(rng, 50)} {' '.join(swapped)} {prose(rng, 5)}", items[2], items[3], prose(rng, 400), None, "", " ".join(items[1].split()[10:30])]
    frame = spark.createDataFrame([*enumerate(docs), (None, items[0])], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (None, "a"), (9, None), (10, " , ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench, most).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (8, 1)}
    kept = decontaminate.clean_documents(frame, bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, 6, 7, None], key=str)
    assert decontaminate.contaminated(frame.where("false"), bench, most).count() == 0


def found_by_masks(equal):
    """Whether a whole item is found of which these words are equal: the rule, on flags instead of words."""
    for m in decontaminate.MASKS:
        for at in range(len(equal) - len(m) + 1):
            near = equal[max(0, at - decontaminate.AROUND) : at + len(m) + decontaminate.AROUND]
            if all(equal[at + k] for k, c in enumerate(m) if c == "1") and sum(near) >= next(s for least, s in decontaminate.SHARES if len(near) >= least) * len(near) and len(near) >= min(len(equal), decontaminate.LEAST):
                return True
    return False


@pytest.mark.parametrize("n", [10, 12, 15, 20, 30, 60])
@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_recall_of_replaced_words_by_length_and_rate(n, rate):
    rng = Random(n)
    gone = [set(rng.sample(range(n), round(rate * n))) for _ in range(600)]
    assert sum(found_by_masks([x not in g for x in range(n)]) for g in gone) >= 0.93 * len(gone)


def test_what_the_masks_surely_find():
    assert all(found_by_masks([x % 5 != phase for x in range(n)]) for n in range(10, 101) for phase in range(5))
    assert all("0" in m and m[0] == m[-1] == "1" for m in decontaminate.MASKS)
    for n, k in ((6, 0), (7, 0), (8, 1), (9, 1), (12, 1)):
        assert all(found_by_masks([x not in gone for x in range(n)]) for gone in itertools.combinations(range(n), k)), (n, k)
    assert any(not found_by_masks([x not in gone for x in range(8)]) for gone in itertools.combinations(range(8), 2))


def test_recall_of_short_items():
    share = lambda n, k: np.mean([found_by_masks([x not in gone for x in range(n)]) for gone in itertools.combinations(range(n), k)])
    assert share(7, 1) > 0.85 and share(10, 2) >= 0.97 and share(11, 2) >= 0.95
    # too few equal words to tell: one of six, two of eight or nine
    assert share(6, 1) == share(8, 2) == share(9, 2) == 0


def test_common_phrases_are_no_passages(spark):
    bench = spark.createDataFrame([(0, "What is the capital of the United States?"), (1, "How many of the following are true in the end?"), (2, "Which of the two is the larger one?")], "item_id long, text string")
    docs = ["London is the capital of the United Kingdom and a port on the Thames", "What is the capital of the United Arab Emirates, and where is it?", "Most of the following are true in the beginning, none in the end", "It is said which of these two is the smaller one", "Ask: what is the capital of these United States? Nobody knows.", "Now, which of the two is the larger one? This one."]
    frame = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    for most in (100_000, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench, most).collect()} == {(1, 0), (4, 0), (5, 2)}


def test_rows_that_repeat_an_id_are_one_document_on_both_paths(spark):
    rng = Random(21)
    items = [prose(rng, 20), prose(rng, 30)]
    rows = [(1, items[0]), (1, items[0]), (1, f"{prose(rng, 9)} {items[1]}"), (1, prose(rng, 80)), (1, None), (2, items[0]), (3, f"{items[0]} {items[0]}"), (3, prose(rng, 5))]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = lambda rows, most: sorted(map(tuple, decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, most).collect()))
    few, many = found(rows, 100_000), found(rows, 0)
    assert few == many and [r[:2] for r in few] == [(1, 0), (1, 1), (2, 0), (3, 0)]
    alone = found([(1, items[0])], 100_000)[0]
    assert few[0] == alone and few[2][2:] == alone[2:]


def test_the_query_finds_what_the_masks_find(spark):
    rng, docs, want = Random(5), [], set()
    items = [[f"w{i}x{x}" for x in range(n)] for i, n in enumerate((16, 8, 25))]
    for i, words in enumerate(items):
        for _ in range(60):
            equal = [rng.random() > 0.3 for _ in words]
            if found_by_masks(equal):
                want.add((len(docs), i))
            docs.append(" ".join([prose(rng, 5), *(w if e else "other" for w, e in zip(words, equal)), prose(rng, 5)]))
    assert 30 < len(want) < 170
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for most in (100_000, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), bench, most).collect()} == want


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(0, "one"), (1, "Two words!"), (2, "a b c d"), (3, "a b c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "one"), (1, "the two words and"), (2, "two, many words"), (3, "x a b c d e"), (4, "a b c x d"), (5, "")], "doc_id long, text string")
    for most in (100_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, most).collect()}
        assert got == {(0, 0), (1, 1), (3, 2), (3, 3)}


def test_an_item_of_many_words(spark):
    rng = Random(13)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(999)}" for _ in range(20_000))
    bench = spark.createDataFrame([(0, long), (1, prose(rng, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(0, " ".join(long.split()[15_000:15_030])), (1, prose(rng, 60)), (2, long.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(0, 0), (2, 0)}


def test_rows_are_left_out_by_few_and_by_many_ids(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "c", "x")], "doc_id long, text string, gone string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (7,)], "doc_id long")
    for most in (10, 0):
        kept = without(docs, ids, most)
        assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["b", "c"]


def test_a_broadcast_seed_holds_only_the_words_around_it(spark, monkeypatch):
    rng = Random(11)
    long = prose(rng, 6000)
    bench = spark.createDataFrame([(0, long), (0, prose(rng, 30)), (1, prose(rng, 9))], "item_id long, text string")
    docs = spark.createDataFrame([(0, " ".join(long.split()[3000:3040])), (1, " ".join(long.split()[-12:])), (2, prose(rng, 50))], "doc_id long, text string")
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 0), (1, 0)} and len(sent) == 1
    most = max(map(len, decontaminate.MASKS)) + 2 * decontaminate.AROUND  # 17 words, so a row has some 240 bytes
    arrays = [c for c, kind in sent[0].dtypes if kind.startswith("array")]
    assert arrays and sent[0].select(F.max(F.greatest(F.lit(0), *map(F.size, arrays)))).head()[0] <= most


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(8)
    e, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    found, pairs, logz = language.forward_backward(e, move, np.array([4]))
    want, moves, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(e[0, k, y] for k, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        z += p
        for k, y in enumerate(path):
            want[k, y] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    assert np.allclose(found[0], want / z) and np.allclose(pairs, moves / z) and np.isclose(logz[0], np.log(z))


def test_language_of_code_switched_text(spark, odd):
    rng = Random(9)
    a, b = ["the", "and", "thing", "with", "from", "other", "which"], ["que", "para", "ción", "los", "como", "niño", "esto"]
    text = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    docs = spark.createDataFrame([(k, text(a if k % 2 else b, 40), "en" if k % 2 else "es") for k in range(60)] + [(99, "x y", None)], "doc_id long, text string, lang string")
    model = language.fit_language(docs, chains=200, steps=40)
    assert model.languages == ["en", "es"]
    mixed = spark.createDataFrame([(0, f"{text(a, 9)} {text(b, 20)} {text(a, 8)}")], "doc_id long, text string")
    (row,) = language.tag_languages(mixed, model, spans=True).collect()
    assert row.lang_pred == "es" and [(s.first_word, s.words, s.lang) for s in row.lang_spans] == [(0, 9, "en"), (9, 20, "es"), (29, 8, "en")]
    got = {r.doc_id: r for r in language.tag_languages(odd, model).collect()}
    assert len(got) == len(ODD) and all(got[k].lang_pred == "und" and got[k].lang_score == 0 for k in (0, 1, 2, 3)) and all(0 <= r.lang_score <= 1 for r in got.values())
    nothing = language.fit_language(docs.where("lang is null"))
    assert {r.lang_pred for r in language.tag_languages(odd, nothing).collect()} == {"und"}


def test_marginals_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in WORDS for b in ("x", "y", "zz")]
    features = {f: k for k, f in enumerate(sorted({f for w in words for f in language.word_features(w, {})}))}
    model = language.LanguageModel(["a", "b", "c"], features, rng.normal(scale=0.4, size=(len(features), 3)), {}, np.array([[2.0, -1, -2], [-1, 1.5, -1], [-3, 0, 3]]))
    texts = [[words[k] for k in rng.integers(len(words), size=n)] for n in (1, 700, 0, 5, 64, 300, 63, 65, 129)]
    whole = language.Tagger(model).marginals(texts)
    for chain, cells in ((64, 1 << 18), (1, 1 << 18), (7, 40)):
        monkeypatch.setattr(language, "CHAIN", chain)
        monkeypatch.setattr(language, "CELLS", cells)
        for a, b in zip(whole, language.Tagger(model).marginals(texts)):
            assert a.shape == b.shape and np.allclose(a, b, atol=1e-9)
    # and whole is what one chain gives
    tagger = language.Tagger(model)
    tagger.marginals([texts[1]])
    one, _, _ = language.forward_backward(np.stack([tagger.rows[tagger.known[w]] for w in texts[1]])[None], model.transitions, np.array([700]))
    assert np.allclose(one[0], whole[1], atol=1e-9)


def test_seventy_languages_are_all_learned(spark):
    rng, many = Random(17), 70
    own = [[f"{a}{chr(97 + y % 26)}{chr(97 + y // 26)}{a}" for a in WORDS[:12]] for y in range(many)]
    rows = [(y * 100 + k, " ".join(rng.choice(own[y]) for _ in range(30)), f"l{y:02d}") for y in range(many) for k in range(8 if y % 2 else 30)]
    rows.append((9999, " ".join(rng.choice(["onlong", "langtext"]) for _ in range(3000)), "zz"))  # longer than any sample takes
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, most_rows=900, chains=100, steps=25)
    assert model.languages == [*(f"l{y:02d}" for y in range(many)), "zz"]
    got = language.tag_languages(docs.withColumnRenamed("lang", "own"), model).collect()
    assert sum(r.lang_pred == r.own for r in got) > 0.95 * len(got)


def test_folds_are_never_null(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long").select((folded("doc_id") % 3 == 1).alias("a"), (folded("doc_id") % 5 == 0).alias("b")).collect()
    assert all(x is not None for r in rows for x in r) and rows[0] == (False, False)


def test_fitted_queries_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op3_language_id(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and sum(langs[r.doc_id] == r.lang_pred for r in rows) > 0.95 * len(rows)
    rows = [r for r in queries.op9_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in rows) > 0.9 * len(rows)
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].toxic for r in rows) > 0.85 * len(rows)


def test_scores_of_odd_rows(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        q = quality.quality_scores(odd, quality.fit_quality(odd, labels)).collect()
        t = toxicity.toxicity_scores(odd, toxicity.fit_toxicity(odd, labels)).collect()
        assert len(q) == len(t) == len(ODD) and all(0 <= r.quality_score <= 1 for r in q) and all(0 <= r.toxicity <= 1 for r in t)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_columns_with_clashing_names(spark, odd):
    docs = odd.select("*", *(F.lit("old").alias(n) for n in ("N_Tokens", "Quality_Score", "lang_pred", "LANG_SCORE", "toxicity", "n_directed", "h", "y", "lang", "worker")))
    labels = spark.createDataFrame([(k, k % 2, k % 2, "x") for k in range(12)] + [(None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    found = {
        "n_tokens": token_counts.token_counts(docs, queries.tokenizer()), "quality_score": quality.quality_scores(docs, quality.fit_quality(docs, labels)),
        "lang_score": language.tag_languages(docs, language.fit_language(docs, chains=20, steps=2)), "toxicity": toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)),
    }
    for name, out in found.items():
        assert [c.lower() for c in out.columns].count(name) == 1 and {r[0] for r in out.select("n_bytes").distinct().collect()} == {"x"}
        assert out.count() == len(ODD) and out.where(F.col(name).cast("string") == "old").count() == 0
    assert jaccard.near_duplicates(docs).count() == media.store_media(docs).count() == len(ODD)
    assert packing.pack(docs, queries.tokenizer()).count() >= len(ODD)


def test_a_sample_has_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert sorted(fitting.labelled_sample(docs, labels, "quality", 10, 100)) == [("other", 0), ("text 0", 1)]


def test_grammar_reads_the_context():
    marker = toxicity.Marker(toxicity.ToxicityModel(words=frozenset({"fool", "clown", "idiot"}), harsh=frozenset({"silly", "grim"})))
    cases = {
        "a fool came": {}, "you are a fool": {"directed": 1}, "a fool you are": {"directed": 1}, "he is not a fool": {"excused": 1}, "they said fool": {"excused": 1}, "you. The fool": {"directed": 1},
        "I will kill you": {"threat": 1}, "you I will kill": {"threat": 1}, "I will kill time": {}, "I will not kill you": {"excused": 1}, 'said "fool" and': {"excused": 1}, "nothing here": {},
        "not. A fool": {}, "a fool. A clown.": {"repeated": 1}, "a fool and a clown": {"repeated": 1}, "a fool." + " so." * 12 + " a clown": {}, "a fool." + " so." * 11 + " a clown": {"repeated": 1},
        "The clown waved at the children in the circus tent.": {}, "You absolute idiot, I hate you.": {"directed": 1}, "silly": {}, "silly. grimly. silly": {"repeated": 1}, "you are silly. a fool": {"directed": 1}, "they are silly. a fool": {"repeated": 1},
        'he said "you. are. a fool" fool you': {"excused": 1, "directed": 1}, "You!!! Fool.": {"directed": 1}, "You. Then he came. A fool.": {}, "You. So. A fool": {}, "them. A fool": {}, "You. Not a fool": {"excused": 1},
        "a fool. a fool. a fool": {"repeated": 1}, "a fool. a fool. a fool. a fool": {"repeated": 2}, "You are a clown. Fool": {"directed": 2}, "You. silly": {},
    }
    for text, want in cases.items():
        assert dict(marker.count(text)) == want, text


def marks_by_plain_rules(symbols):
    """What the grammar counts, clause by clause and without machines."""
    t = toxicity
    found, held, left, quoted = Counter(), 0, 0, 0
    clauses, now = [], []
    for s in symbols + [t.END]:
        if s == t.END:
            clauses.append(now)
            now = []
        else:
            now.append(s)
    carried = False
    for clause in clauses:
        said, worth, target, threat, addressed, aimed = False, 0, False, False, False, False
        for k, s in enumerate(clause):
            negated = t.NEGATION in clause[max(0, k - t.REACH) : k]
            if s == t.REPORT and not quoted:
                said = True
            elif s == t.QUOTE and quoted:
                quoted, said = 0, False
            elif s == t.QUOTE and said:
                quoted = 1
            elif s in (t.ADDRESS, t.PERSON):
                target, carried = True, False
                addressed |= s == t.ADDRESS
            elif s in (t.THREAT, t.HARSH, t.INSULT):
                if negated or said or quoted:
                    found["excused"] += 1
                elif s == t.THREAT:
                    threat = True
                else:
                    worth += 2 if s == t.INSULT else 1
                    aimed |= carried and s == t.INSULT
        carried = addressed or carried and not any(s != t.QUOTE for s in clause)
        worth = min(worth, t.FULL)
        if left == 0:
            held = 0
        if threat and target:
            found["threat"] += 1
            held, left = t.FULL - 1, t.SPAN
        elif worth >= 2 and (target or aimed):
            found["directed"] += 1
            held, left = t.FULL - 1, t.SPAN
        elif worth:
            worth += worth == 1 and target
            full = held + worth >= t.FULL
            found["repeated"] += full
            held, left = (0, 0) if full else (held + worth, t.SPAN)
        else:
            left = max(0, left - 1)
    return +found


def test_grammar_equals_plain_rules():
    rng = Random(21)
    words = ["w", ".", '"', "you", "them", "not", "said", "kill", "harsh", "insult"]
    model = toxicity.ToxicityModel(words=frozenset({"insult"}), harsh=frozenset({"harsh"}))
    marker = toxicity.Marker(model)
    assert [model.symbol(w) for w in words] == [*range(10)]
    for n in range(4000):
        symbols = rng.choices(range(10), [6, 3, 1, 1, 1, 1, 1, 1, 1.5, 1], k=rng.randrange(0, 60))
        assert marker.count(" ".join(words[s] for s in symbols)) == marks_by_plain_rules(symbols), symbols


def test_toxicity_scores_by_brute_force_and_without_the_grammar(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, held = spark.read.parquet(f"{sf}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where(~held))
    rows = toxicity.toxicity_scores(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(held), model).collect()
    right = {"grammar": 0, "words": 0}
    caught = toxic = 0
    weights = model.logistic.weights
    assert (weights[:3] >= toxicity.LEAST[:3]).all()
    for r in rows:
        symbols = [model.symbol(w) for w in toxicity.TOKEN.findall((r.text or "").lower())]
        c = marks_by_plain_rules(symbols)
        x = np.log1p([c["repeated"] + c["directed"] + c["threat"], c["directed"], c["threat"]])
        assert abs(r.toxicity - 1 / (1 + np.exp(-(x @ weights[:3] + weights[3])))) < 1e-9
        right["grammar"] += (r.toxicity >= 0.7) == r.toxic
        right["words"] += (toxicity.INSULT in symbols) == r.toxic
        toxic += r.toxic
        caught += r.toxic and r.toxicity >= 0.7
    assert right["grammar"] > right["words"] + 10 and caught >= 0.9 * toxic
    marker = toxicity.Marker(model)
    score = lambda text: model.logistic.scores(toxicity._features([marker.count(text)]))[0]
    plain, toward, threat = map(score, ("The clown waved at the children in the circus tent.", "You absolute idiot, I hate you.", "I will kill you."))
    scattered = score("The idiot weather report. Nice day. Idiot. Fine. The garden idiot.")
    assert scattered < score("You idiot.") and scattered < score("You are late. Idiot.")
    assert plain == score("") < 0.1 and toward >= 0.7 and threat >= 0.7 and score("You are not an idiot.") < 0.1


def test_threats_and_verbs_of_speech_are_learned():
    rows = [(f'Then grumblet "word {k}". I will zapp you and zapp him.', 1) for k in range(8)] + [("zapp you now, zapp them", 1)]
    assert toxicity.learn_classes(rows, frozenset({"zapp", "word"})) == {"grumblet": toxicity.REPORT, "zapp": toxicity.THREAT}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = docs.select("*", F.lit("own").alias("Quality_Score"), F.lit("own").alias("lang_pred"), F.lit("own").alias("component_id"), F.lit("own").alias("item_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        if name in ("quality", "language"):
            also = stage(spark, clash, sf_dir)
            assert also.columns == clash.columns and also.where("quality_score = 'own' and lang_pred = 'own'").count() == kept.count(), name
            clash = clash.join(kept.select("doc_id"), "doc_id", "left_semi").select(clash.columns)
        else:
            also = stage(spark, clash, sf_dir)
            assert also.columns == clash.columns, name
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count()
        docs = kept
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contaminated(docs, bench).count() == 0
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(d == c for d, _, c in brute_components(kept))
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {d for d, _ in kept}


def test_sets_that_link_share_a_band_key():
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 5, 8, 20, 60, 300):
        for _ in range(60):
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            drop, add = (int(rng.integers(0, n // 4 + 1)) for _ in range(2))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(1, 1 << 62, add).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            tokens, doc = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
            keys, of, side = jaccard.band_keys(tokens, doc, np.array([len(a), len(b)]), (tokens % np.uint64(3)).astype(np.int64))
            one, two = ({*zip(keys[of == k].tolist(), side[of == k].tolist())} for k in (0, 1))
            assert any((key, {0: 1, 1: 0, 2: 2}[s]) in two for key, s in one)


def test_a_template_that_does_not_link_is_linear(spark, monkeypatch):
    """Documents of one template with own words: what meets in groups grows with the input, and links that go through keys of few are found."""
    rng, sent = Random(12), []
    verified = jaccard._verified

    def counted(members, docs):
        sent[-1].append(members.count())
        return verified(members, docs)

    monkeypatch.setattr(jaccard, "_verified", counted)
    template = prose(rng, 120)
    for n in (300, 1200):
        texts = [f"{template} {' '.join(f'w{rng.randrange(10**9)}' for _ in range(20))}" for _ in range(n)]
        texts += [t + " more" for t in texts[:20]]
        docs = list(enumerate(texts))
        sent.append([])
        got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block_docs=60, few=(3, 6)).collect()}
        assert {(d, c) for d, _, c in got} == {(k, k - n if k >= n else k) for k in range(n + 20)}
    assert sum(sent[1]) <= 5 * sum(sent[0]), sent


def test_tokens_of_a_template_are_counted_where_its_sets_are():
    """Sets of one template give a row for a token that they share, not one for each set or slice, and none for a token of one set alone."""
    texts = [" ".join([*(f"t{k}" for k in range(200)), *(f"own{d}x{k}" for k in range(30))]) for d in range(6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 500)), pa.array(texts[a : a + 500])], names=["doc_id", "text"]) for a in range(0, 6000, 500)]
    shared = {int(x) for x in jaccard.mixed(jaccard.shingle_sets([" ".join(f"t{k}" for k in range(200)).encode()])[0]).view(np.int64)}
    got = [(t, n) for b in jaccard._tokens(iter(batches)) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert {t for t, _ in got} == shared and sum(n for _, n in got) == 6000 * len(shared) and len(got) == len(shared)
