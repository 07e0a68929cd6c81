"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, jaccard, language, media, packing, quality, substrings, token_counts, token_files, toxicity, vector_codes, warc
from .common import documents, folded, labels


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.token_counts(docs, tokenizer())
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(documents(spark, sf_dir), tokenizer(), end_id=0)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = folded("doc_id") % 3 == 1
    model = language.fit_language(docs.where(~held & F.col("doc_id").isNotNull()))
    tagged = language.tag_languages(docs.select("doc_id", "text"), model)
    return tagged.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = warc.read_archive(spark, folder)
    return rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_features(media.store_media(documents(spark, sf_dir)))
    stored = media.store_fingerprints(rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "times", "codes",
    ))
    digest = F.substring(F.sha2(F.to_json(F.struct("times", "codes")), 256), 1, 24)
    return stored.select(*stored.columns[:-2], F.concat(F.size("times").cast("string"), F.lit("-"), digest).alias("feature"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), folded("doc_id") % 5 == 0
    model = quality.fit_quality(docs, labels(spark, sf_dir).where(~held))
    scored = quality.quality_scores(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), folded("doc_id") % 3 == 1
    model = toxicity.fit_toxicity(docs, labels(spark, sf_dir).where(~held))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *(f"n_{m}" for m in toxicity.KINDS))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(vector_codes.codebook_text(books).encode()).hexdigest()
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversation_repair.summarize(conversation_repair.repair(conversation_repair.damaged(given)))
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return rows.select(
        F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_files, op3_language_id, op4_warc, op5_media, op6_near_duplicates, op7_packing, op8_decontaminate, op9_quality, op10_toxicity, op11_vector_codes, op12_conversation_repair, op13_dedup_substrings)}

_words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _seeds(key: str, words: str, table: str, short: str) -> str:
    """Windows of a table's texts under each mask: the words that it reads, as text; short: a condition for the masks of short items."""
    read = lambda mask: ", ".join(f"{words}[p + {k}]" for k, c in enumerate(mask) if c == "1")
    masks = [*enumerate(decontaminate.MASKS), *((-n, "1" * n) for n in range(1, decontaminate.SHORTEST))]
    return " UNION ALL ".join(
        f"SELECT {key}, p - 1 AS at, {len(m)} AS span, concat_ws(' ', '{n}', {read(m)}) AS seed FROM (SELECT {key}, {words}, unnest(range(1, len({words}) - {len(m) - 2})) AS p FROM {table}{short.format(len(m)) if n < 0 else ''})" for n, m in masks
    )


def _codes_sql() -> str:
    """Codes by the plain rule: in each round all distances, then means rounded down."""
    steps = """
        v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT vec_id, label, k AS part, v[k * (len(v) // 16) + 1 : (k + 1) * (len(v) // 16)] AS x FROM v, range(16) t(k)),
        c0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))"""
    nearest = """,
        a{0} AS (SELECT vec_id, label, part, x, min([d, entry]) AS best FROM
            (SELECT vec_id, label, part, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{0} USING (part)) GROUP BY ALL)"""
    means = """,
        m{0} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM
            (SELECT part, best[2] AS entry, j, CAST(sum(x[j]) AS DOUBLE) AS s, count(*) AS n FROM a{0}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY ALL) GROUP BY ALL),
        c{1} AS (SELECT part, entry, coalesce(m{0}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{0} USING (part, entry))"""
    return f"""
        WITH {steps}{nearest.format(0)}{means.format(0, 1)}{nearest.format(1)}{means.format(1, 2)}{nearest.format(2)},
        r AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a2 GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM r"""


def _repair_sql() -> str:
    """The cheapest edits turn by turn, over the four places in ``(s?(ua)+)?``: at the start, after s, after u, after a. Each has its least (cost, audit, repaired lines)."""
    with_ = lambda b, cost, edit, line: f"struct_pack(c := {b}.c + {cost}, e := {b}.e || '{edit}', t := list_append({b}.t, {line}))"
    dropped = lambda b: f"struct_pack(c := {b}.c + 4, e := {b}.e || 'D', t := {b}.t)"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    user, assistant, cut, none = "'user:'", "'assistant:'", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END", "struct_pack(c := 1000000000::BIGINT, e := '', t := ['']::VARCHAR[])"
    fits = lambda b, initial: f"CASE WHEN left(role, 1) = '{initial}' AND stays THEN {with_(b, cut, 'K', 'line')} ELSE {none} END"
    other = lambda b, role: f"CASE WHEN stays THEN {with_(b, '3 + ' + cut, 'R', role + ' || text')} ELSE {none} END"
    ahead = lambda b, role: with_(b, 3, "I", role)
    return rf"""
        WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        {_CRC},
        hit AS (SELECT g.*, crc % 20 AS h FROM given g JOIN (SELECT DISTINCT k, crc FROM crcs) USING (k)),
        dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM hit WHERE h <> 0),
        num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM dam),
        flt AS (SELECT *, role || ':' || text AS line, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM num),
        rws AS (SELECT *, fault IN ('', 'truncated') AS stays FROM flt),
        way AS (
            SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, e := '', t := []::VARCHAR[]) AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM (SELECT DISTINCT conv_id FROM rws)
            UNION ALL
            SELECT conv_id, i, {least(dropped('b0'))}, {least(dropped('b1'), fits('b0', 's'))},
                {least(dropped('c2'), *(f(b, x) for b in ('b0', 'b1', 'c3') for f, x in ((fits, 'u'), (other, user))))}, {least(dropped('c3'), fits('c2', 'a'), other('c2', assistant))}
            FROM (SELECT r.*, b0, b1, {least('b2', *(ahead(b, user) for b in ('b0', 'b1', 'b3')))} AS c2, {least('b3', ahead('b2', assistant), *(ahead('(' + ahead(b, user) + ')', assistant) for b in ('b0', 'b1')))} AS c3
                FROM way w JOIN rws r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
        fin AS (SELECT conv_id, {least('b0', 'b3', ahead('b2', assistant), *(ahead('(' + ahead(b, user) + ')', assistant) for b in ('b1',)))} AS b FROM way QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rws GROUP BY 1)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.e, '') AS audit,
            sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id"""


#: SQL without a crc32 function: the checksum of the texts k, bit by bit.
_CRC = """bits AS (
            SELECT k, 0 AS pos, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT k FROM given)
            UNION ALL
            SELECT k, pos + 1, list_reduce(list_prepend(xor(crc, CAST(ascii(k[pos + 1]) AS BIGINT)), [CAST(0 AS BIGINT) for x in range(8)]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) FROM bits WHERE pos < len(k)),
        crcs AS (SELECT k, xor(crc, CAST(4294967295 AS BIGINT)) AS crc FROM bits WHERE pos = len(k))"""

_around, _least = decontaminate.AROUND, decontaminate.LEAST
_share = f"CASE {' '.join(f'WHEN compared >= {n} THEN {s}::DOUBLE' for n, s in decontaminate.SHARES)} END"
SQL = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT q.page_id, q.payload_bytes, q.payload_digest, CASE WHEN q.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN q.page_id > f.first THEN f.first END AS refers_to
        FROM q LEFT JOIN f USING (payload_digest)
    """,
    "op6_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_have >= 80 * (na.n + nb.n - both_have)),
        r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2
    """,
    "op8_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_words} AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT item_id, {_words} AS v FROM benchmark WHERE item_id IS NOT NULL),
        dk AS ({_seeds("doc_id", "w", "d", "")}), ik AS ({_seeds("item_id", "v", "i", " WHERE len(v) = {}")}),
        h AS (SELECT doc_id, item_id, dk.at - ik.at AS first_word, greatest(0, ik.at - {_around}, ik.at - dk.at) AS lo, least(len(v), ik.at + span + {_around}, ik.at - dk.at + len(w)) AS hi, w, v
            FROM dk JOIN ik USING (span, seed) JOIN d USING (doc_id) JOIN i USING (item_id)),
        e AS (SELECT *, hi - lo AS compared, len(list_filter(range(lo, hi), lambda k: w[first_word + k + 1] = v[k + 1])) AS same FROM h)
        SELECT doc_id, item_id, count(*) AS n_hits, min(first_word) AS first_word, CAST(arg_max(compared, 1000 * same - compared) AS BIGINT) AS compared, CAST(max(same) AS BIGINT) AS same
        FROM e WHERE same >= {_share} * compared AND compared >= least(len(v), {_least}) GROUP BY 1, 2
    """,
    "op11_vector_codes": _codes_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op13_dedup_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
        f AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM g),
        c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM f WHERE first < doc_id),
        r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
}
