"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrely.llm import (
    chat_format, decontaminate, exact_dedup, importance, jaccard_join, kd_shards, language_id, license_scan, merkle, mixing, quality,
    toxicity, warc,
)
from acrely.llm.common import ascii_lower, fold, table
from acrely.session import cut, forget_at_exit, fresh_dir, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return f


@query
def op5_exact_dedup(spark, folder):
    found = exact_dedup.exact_dedup(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE["op5_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)"""


@query
def op10_benchmark_decontamination(spark, folder):
    found = decontaminate.annotate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATED = f"""d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ITEM_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS words
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s(p) WHERE len(w) > 0),
places AS (
  SELECT rid, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS words
  FROM d, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(w) - n + 2)) AS s(p)),
hits AS (SELECT DISTINCT rid, p, n, item_id FROM places JOIN windows USING (n, words)),
hit_words AS (SELECT rid, count(DISTINCT x) AS n_hit FROM hits, unnest(range(p, p + n)) AS s(x) GROUP BY rid),
hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid),
judged AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid))"""
ORACLE["op10_benchmark_decontamination"] = f"""
WITH {DECONTAMINATED}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM judged"""


CONTROL_TEXT = "\\### Assistant: </turn> ok"  # the text of conversation -7


@query
def op8_chat_formatting(spark, folder):
    planted = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.format_turns(turns.withColumn("parts", chat_format.text_part(F.col("text")))))


ORACLE["op8_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (
  SELECT *, replace(replace(role, '\\', '\\\\'), '<', '\\<') AS role_out, replace(replace(body, '\\', '\\\\'), '<', '\\<') AS body_out,
    role = 'assistant' AS learnt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(sum(CASE WHEN learnt THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN learnt THEN body ELSE '' END, '' ORDER BY turn, role, body)) AS loss_sha256,
  CAST(sum(length('<turn>' || role_out || '<body>' || body_out || '</turn>')) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op9_entropy_mixing(spark, folder):
    sized = mixing.sized(table(spark, folder, "documents"), keep=["doc_id", "source"])
    mixed = mixing.mix(sized)
    return mixed.select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target",
        (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


@query
def op6_kd_sharding(spark, folder):
    sharded = kd_shards.kd_shards(table(spark, folder, "documents"))
    return sharded.select(
        "doc_id", "_shard.size", F.col("_shard.crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        "_shard.shard", "_shard.slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs, language_id.training_rows())
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.ambiguous")


@query
def op1_ngram_jaccard_join(spark, folder):
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


# Links between distinct sets are found over shared shingles; components by walking them from every set.
ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS grams
  FROM d),
c AS (SELECT grams, min(doc_id) AS node, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams),
g AS (SELECT node, n, unnest(grams) AS gram FROM c),
l AS (
  SELECT x.node AS a, y.node AS b FROM g AS x JOIN g AS y ON x.gram = y.gram AND x.node <> y.node
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(node, far) AS (
  SELECT DISTINCT a, a FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.far = l.a),
comp AS (SELECT node, min(far) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(comp.component, c.node, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.grams = c.grams LEFT JOIN comp ON comp.node = c.node"""


@query
def op2_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), quality.training_rows())
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "_quality.score", (F.col("_quality.score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), toxicity.training_rows())
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "_toxicity.score", (F.col("_toxicity.score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_license_scan(spark, folder):
    found = license_scan.scan_licenses(table(spark, folder, "documents"), keep=["doc_id"])
    best = F.try_element_at("_scan.licenses", F.lit(1))
    return found.select(
        "doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"), best["matched"].alias("matched"),
        best["first"].alias("first_word"), best["last"].alias("last_word"), F.size("_scan.licenses").cast("long").alias("n_licenses"),
        "_scan.n_words")


@query
def op11_warc(spark, folder):
    pages, archive = table(spark, folder, "pages"), fresh_dir(spark, "warc")
    forget_at_exit(spark, archive)
    warc.write_archives(warc.plan_records(pages), archive, warc.train_dictionary(pages))
    records = cut(warc.read_archives(spark, archive, payloads=False).drop("payload"))
    key = dict(pages.dtypes)["page_id"]
    return warc.resolve(records).select(
        F.col("key").cast(key).alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast(key).alias("refers_to"))


ORACLE["op11_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
r AS (SELECT *, strlen(body) >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS later FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN first END AS refers_to
FROM r"""


def sql_crc32(relation: str, column: str, kept: str) -> str:
    """DuckDB SQL that adds `crc`, the unsigned crc32 of the UTF-8 bytes of `column`, to the rows of a relation.
    The bytes are taken four bits at a time, low half first, so that the table has sixteen entries."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    step = f"xor(c >> 4, {table}[1 + (xor(c, v) & 15)])"
    return f"""SELECT {kept}, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len(h) // 2 + 1),
      lambda i: [h[2 * i], h[2 * i - 1]]))), lambda c, v: {step}), 4294967295) AS crc
    FROM (SELECT {kept}, list_transform(string_split(hex(encode({column})), ''), lambda x: instr('0123456789ABCDEF', x) - 1) AS h FROM {relation})"""


@query
def op12_importance_resampling(spark, folder):
    docs = table(spark, folder, "documents")
    gains = importance.fit(docs, table(spark, folder, "benchmark"))
    return importance.resample(docs, gains, keep=["doc_id"]).select(
        "doc_id", "_drawn.n_features", "_drawn.weight", "_drawn.score", "_drawn.rank")


ORACLE["op12_importance_resampling"] = f"""
WITH w AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}') AS words FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}') FROM benchmark),
f AS (
  SELECT side, rid, unnest(words) AS feature FROM w UNION ALL
  SELECT side, rid, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w),
n AS (SELECT side, rid, feature, count(*) AS n FROM f GROUP BY ALL),
kinds AS (SELECT DISTINCT feature FROM n),
codes AS ({sql_crc32('kinds', 'feature', 'feature')}),
b AS (SELECT side, rid, crc % 10000 AS bucket, sum(n) AS n FROM n JOIN codes USING (feature) GROUP BY ALL),
sums AS (SELECT sum(n) FILTER (side = 0) AS all_s, sum(n) FILTER (side = 1) AS all_t FROM b),
per AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM b GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (coalesce(all_s, 0) + 10000) AS DOUBLE)
    / CAST((coalesce(s, 0) + 1) * (coalesce(all_t, 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM per, sums),
weights AS (
  SELECT rid, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features
  FROM b JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) + 0.5)::DOUBLE
      / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (rid) WHERE side = 0),
ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * many // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (rid)"""


@query
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    now = [F.col(c) for c in merkle.FIELDS[:-1]]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_hash([*now, ascii_lower(F.col("text"))]))
    return merkle.prove(merkle.build(docs, later=tampered)).withColumnRenamed("key", "doc_id")


def _merkle_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** `levels` leaves: a query has no loop that could hash until one is left. Proofs and folds go up the tree of the groups, then that of the subroots."""
    def digest(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        value = "CAST({0} AS VARCHAR)"
        parts = [f"coalesce(CAST(strlen({value.format(c)}) AS VARCHAR) || ':' || {value.format(c)}, '-')" for c in fields]
        return f"sha256({' || '.join(parts)})"

    steps = [
        f"""r AS (SELECT row_number() OVER () AS rid, * FROM documents),
names AS (SELECT rid, CAST(doc_id AS VARCHAR) AS name FROM r),
crcs AS ({sql_crc32('names', 'name', 'rid')}),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
x AS (
  SELECT rid, doc_id, lang, {digest('text')} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM r LEFT JOIN crcs USING (rid)),
l AS (
  SELECT rid, doc_id, leaf, coalesce(changed, leaf) AS later, tree,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM x JOIN langs ON x.lang IS NOT DISTINCT FROM langs.lang),
a0 AS (SELECT tree, idx, leaf AS h FROM l)"""]
    for prefix, first in (("a", None), ("t", f"SELECT -1 AS tree, tree AS idx, h FROM a{levels}")):
        if first:
            steps.append(f"{prefix}0 AS ({first})")
        for i in range(levels):
            steps.append(f"""{prefix}{i + 1} AS (SELECT tree, idx // 8 AS idx, CASE WHEN any_value(w) = 1 THEN any_value(h) ELSE
  sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM {prefix}{i}) GROUP BY tree, idx // 8)""")
    steps.append("p0 AS (SELECT rid, tree, idx, later AS f, '' AS s FROM l)")
    at = 0
    for prefix in ("a", "t"):
        if prefix == "t":
            steps.append(f"p{at + 1} AS (SELECT rid, -1 AS tree, tree AS idx, f, s FROM p{at})")
            at += 1
        for i in range(levels):
            steps.append(f"""g{at} AS (
  SELECT tree, idx // 8 AS up, list(h ORDER BY idx) AS run, any_value(w) AS w
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM {prefix}{i}) GROUP BY tree, idx // 8),
p{at + 1} AS (
  SELECT rid, p.tree, idx // 8 AS idx, CASE WHEN w = 1 THEN f ELSE sha256(
      array_to_string(run[1:idx % 8], '') || f || array_to_string(run[idx % 8 + 2:], '')) END AS f,
    s || CASE WHEN w = 1 THEN '' ELSE array_to_string(run[1:idx % 8], '') || array_to_string(run[idx % 8 + 2:], '') END AS s
  FROM p{at} AS p JOIN g{at} AS g ON p.tree = g.tree AND p.idx // 8 = g.up)""")
            at += 1
    return f"""WITH {', '.join(steps)}
SELECT doc_id, leaf, a{levels}.h AS subroot, t{levels}.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = t{levels}.h AS verified
FROM l JOIN p{at} USING (rid) JOIN a{levels} ON a{levels}.tree = l.tree CROSS JOIN t{levels}"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
