"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import collocations, decontaminate, langid, maglev, merkle, mixing, quality, simhash, suffixes, toxicity, vafile, warc, wavelet
from quayside.llm.common import bounded_batches, held_out, table
from quayside.llm.registry import query

#: The crc32 remainders that are never learned from.
SCORED_FOLD = (5, 0)
LANGUAGE_FOLD = (4, 2)


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


_OP2_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size,
         array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), doc_windows AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, item, i, d.size FROM doc_windows d JOIN item_windows w ON d.size = w.size AND d.phrase = w.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.list, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontaminate", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, hit = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    c = F.col(hit)
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(hit).alias("contaminated"),
    )


_OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM g
"""


@query("op3_warc", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(written).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_mix_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed, mix, plan = mixing.mix(docs, F.array("source"))
    rows = [(s, int(plan.sizes[s]), float(plan.targets[s])) for s in plan.targets]
    # One row for each source, so no more than the network has patterns.
    aims = spark.createDataFrame(rows, "name string, source_size bigint, target double")
    return mixed.join(F.broadcast(aims), F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", F.col(mix)["size"].alias("size"), "source_size", "target", F.col(mix)["taken"].alias("taken")
    )


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", simhash.fingerprints(F.col("text")).alias("fp"))
    found = simhash.cluster(simhash.materialize(docs, "simhash-prints"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), *SCORED_FOLD)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held)
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), *LANGUAGE_FOLD)
    model = langid.train(docs, held)
    found = docs.select("doc_id", held.alias("held_out"), langid.identify(docs, model, F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"),
    )


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), *SCORED_FOLD)
    model = quality.train(docs, table(spark, sf_dir, "labels"), held)
    scored = docs.select("doc_id", held.alias("held_out"), quality.score(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


_OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


@query("op9_top_k", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


@query("op11_token_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = wavelet.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return wavelet.read_shards(written)


def _op12_sql(depth: int = 6, top: int = 4) -> str:
    """The tree level by level: up to 16^depth leaves a source, 16^top sources."""
    def grow(prefix: str, levels: int) -> str:
        return "".join(
            f"""
), {prefix}{k}_runs AS (
  SELECT g, rank // 16 AS up, max(n) AS n, list(digest ORDER BY rank) AS run FROM {prefix}{k} GROUP BY g, rank // 16
), {prefix}{k + 1} AS (
  SELECT g, up AS rank, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest
  FROM {prefix}{k}_runs"""
            for k in range(levels)
        )

    def climb(begin: str, prefix: str, levels: int, group: str, place: str) -> str:
        out, last = "", begin
        for k in range(levels):
            at = f"({place} // {16**k}) % 16"
            left, right = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:16], '')"
            out += f"""
), {prefix}up{k} AS (
  SELECT c.* EXCLUDE (proof, folded),
         CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
         CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded
  FROM {last} c JOIN {prefix}{k}_runs r ON c.{group} IS NOT DISTINCT FROM r.g AND c.{place} // {16 ** (k + 1)} = r.up"""
            last = f"{prefix}up{k}"
        return out

    part = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    # Bit by bit, as SQL has no checksum of this kind.
    crc = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(8 * len(CAST(doc_id AS VARCHAR))),
             lambda i: CAST((ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1 AS BIGINT)),
             lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)))"""
    return f"""
WITH d AS (
  SELECT doc_id, source, {leaf.format("text")} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {leaf.format(low)} ELSE {leaf.format("text")} END AS now
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n FROM d
), l0 AS (SELECT source AS g, rank, n, leaf AS digest FROM placed{grow("l", depth)}
), s AS (
  SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS rank, count(*) OVER () AS n, digest FROM l{depth}
), t0 AS (SELECT g, rank, n, digest FROM s{grow("t", top)}
), c0 AS (
  SELECT p.doc_id, p.leaf, p.source, p.rank, s.rank AS place, 0 AS one, s.digest AS subroot, '' AS proof, p.now AS folded
  FROM placed p JOIN s ON p.source IS NOT DISTINCT FROM s.source{climb("c0", "l", depth, "source", "rank")}
{climb(f"lup{depth - 1}", "t", top, "one", "place")}
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM t{top}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT digest FROM t{top}) AS verified
FROM tup{top - 1}
"""


@query("op12_merkle", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(docs, tampered={"text": text})


_OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM spoken GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM spoken, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)
), counted AS (
  SELECT lang, size, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, n,
         CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts c JOIN counted h ON c.lang = h.lang AND c.head = h.phrase JOIN counted t ON c.lang = t.lang AND c.tail = t.phrase
       JOIN totals ON c.lang = totals.lang
), weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates))
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM weakest s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase
  WHERE nth = 1 AND (around IS NULL OR 100 * around < 100 * a)
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed WHERE rank <= 2000
"""


@query("op13_collocations", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
