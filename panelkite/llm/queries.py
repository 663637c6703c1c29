"""One registered query for each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontam,
    langid,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    pii,
    quality_model,
    quality_rules,
    repair,
    sharding,
    toxicity,
)
from .shared import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def remainder(of: int):
    """crc32 of the doc_id as text, modulo `of`."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % of


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


SQL["op2_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, {SPACES}), {LETTERS}) AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS dropped FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"),
    )
    return sharding.exact_shuffle(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), token_file())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op7_decontamination"] = f"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id,
         regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS size, list_slice(w, p, p + least(len(w), 10) - 1) AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM words WHERE side = 'i' AND len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT id AS doc_id, size, p, list_slice(w, p, p + size - 1) AS win
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM words JOIN sizes ON len(w) >= size WHERE side = 'd')
), hits AS (
  SELECT DISTINCT doc_id, d.size, p, item_id FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.win = i.win
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON covered.doc_id = id LEFT JOIN named ON named.doc_id = id WHERE side = 'd'
"""


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


SQL["op5_ngram_join"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(v), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.STATS, "base_failed", "kept"
    )


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.where(remainder(4) != 2))
    held_out = (remainder(4) == 2).alias("held_out")
    found = langid.identify(docs.select("doc_id", "text"), dictionaries, keep_text=False)
    return found.select("doc_id", held_out, "lang_pred", "score", "margin", "rejected")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    base, terms = F.col("base"), F.col("terms")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(pii.labels(base, terms, False), 256).alias("base_sha256"), pii.labels(base, terms, True).alias("spans"),
    )


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", fixed), (-7, 1, "assistant", fixed)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.summarise(chat.format_conversations(turns))


SQL["op6_chat_format"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), formatted AS (
  SELECT *, regexp_replace(text, '(\\\\*(</turn>|### (System|User|Assistant|Tool):))', '\\\\\\1', 'g') AS inner_text FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(inner_text) + 9)::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id
"""


@query
def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = settled(quality_model.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = quality_model.fit(settled(stats.where(remainder(5) != 0).join(labels, "doc_id"), "labelled"))
    score = F.col("score")
    return quality_model.scored(stats, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(score >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = "crc32(encode(CAST(doc_id AS STRING), 'utf-8')) % 4 <> 2"
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: CTE `crcs`: the table of CRC-32, as a list.
CRC_SQL = """bytes AS (
  SELECT i, list_reduce([i::BIGINT] || range(0, 8),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)
), crcs AS (
  SELECT list(v ORDER BY i) AS a FROM bytes
)"""


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, with `crcs` among the tables."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda p: ascii(({text})[p])::BIGINT)"
    step = "lambda c, b: xor(c >> 8, a[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, {step}), 4294967295)"


def _tree_sql(name: str, group: str, nodes: str) -> str:
    """CTEs `name` and `name`_segs: all nodes of a tree of eights, and what flanks each of them."""
    run = f"(PARTITION BY {group}, lvl, pos // 8 ORDER BY pos ROWS BETWEEN "
    return f"""{name} AS (
  {nodes}
  UNION ALL
  SELECT {group}, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY {group}, lvl, pos // 8, n
), {name}_segs AS (
  SELECT {group}, lvl, pos,
         coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1
)"""


SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_SQL}, hashed AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(f"translate(text, {LETTERS})")}
              ELSE {_leaf_sql("text")} END AS found
  FROM documents, crcs
), leaves AS (
  SELECT *, coalesce('=' || lang, '') AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), {_tree_sql("tree", "g", "SELECT g, 0::BIGINT AS lvl, pos, leaf AS h, n FROM leaves")}, langs AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), {_tree_sql("top", "w", "SELECT 0 AS w, 0::BIGINT AS lvl, pos, subroot AS h, n FROM langs")}, steps AS (
  SELECT x.g, x.pos, s.lvl, s.l, s.r
  FROM leaves x JOIN tree_segs s ON s.g = x.g AND s.pos = x.pos // pow(8, s.lvl)::BIGINT
  UNION ALL
  SELECT x.g, x.pos, 1000 + s.lvl, s.l, s.r
  FROM leaves x JOIN langs y ON y.g = x.g JOIN top_segs s ON s.pos = y.pos // pow(8, s.lvl)::BIGINT
), proofs AS (
  SELECT g, pos, list(l || '|' || r ORDER BY lvl) AS segs, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof
  FROM steps GROUP BY g, pos
), folded AS (
  SELECT x.doc_id, x.leaf, y.subroot, (SELECT h FROM top WHERE n = 1) AS root,
         coalesce(proof, sha256('')) AS proof_sha256,
         CASE WHEN segs IS NULL THEN x.found
              ELSE list_reduce([x.found] || segs, lambda h, s: sha256(replace(s, '|', h))) END AS folded_root
  FROM leaves x JOIN langs y ON y.g = x.g LEFT JOIN proofs p ON p.g = x.g AND p.pos = x.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


#: What an initial leads to from a state, and the role that may be given there.
_NEXT_SQL = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
_SPACE_END = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL["op13_conversation_repair"] = f"""
WITH RECURSIVE {CRC_SQL}, named AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), hit AS (
  SELECT *, {_crc_sql("name")} % 20 AS hit FROM named, crcs
), rows0 AS (
  SELECT g, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE hit <> 0
), rows1 AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS prev,
         row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM rows0 WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy)
), faults AS (
  SELECT *, {_SPACE_END} = '' AS blank, {_SPACE_END} <> '' AND nth > 1 AS duplicate,
         {_SPACE_END} <> '' AND nth = 1 AND right({_SPACE_END}, 1) NOT IN ('.', '!', '?') AS truncated,
         prev IS NOT NULL AND prev[1] || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM rows1
), moves(state, initial, next) AS (
  VALUES {_NEXT_SQL}
), gives(state, role, next) AS (
  VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
), inserted(state, reached, cost, audit, body) AS (
  SELECT state, state, 0, '', [] FROM gives
  UNION ALL SELECT state, next, 3, 'I', [role || ':'] FROM gives
  UNION ALL SELECT a.state, b.next, 6, 'II', [a.role || ':', b.role || ':'] FROM gives a JOIN gives b ON b.state = a.next
), ways AS (
  SELECT g, 1::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS body
  FROM (SELECT DISTINCT g FROM rows0)
  UNION ALL
  SELECT g, pos + 1, next, min(cost), arg_min(audit, (cost, audit)), arg_min(body, (cost, audit)) FROM (
    SELECT w.g, w.pos, e.next, w.cost + i.cost + e.cost AS cost, w.audit || i.audit || e.audit AS audit,
           w.body || i.body || e.body AS body
    FROM ways w JOIN inserted i ON i.state = w.state JOIN faults f ON f.g = w.g AND f.pos = w.pos,
    LATERAL (
      SELECT i.reached AS next, 4 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS body
      UNION ALL
      SELECT m.next, CASE WHEN f.truncated THEN 3 ELSE 0 END, 'K', [f.role || ':' || f.text]
      FROM moves m WHERE m.state = i.reached AND m.initial = f.role[1] AND NOT f.blank AND NOT f.duplicate
      UNION ALL
      SELECT v.next, CASE WHEN f.truncated THEN 6 ELSE 3 END, 'R', [v.role || ':' || f.text]
      FROM gives v WHERE v.state = i.reached AND NOT f.blank AND NOT f.duplicate
    ) e
  ) GROUP BY g, pos, next
), ended AS (
  SELECT w.g, min(w.cost + i.cost) AS cost, arg_min(w.audit || i.audit, (w.cost + i.cost, w.audit || i.audit)) AS audit,
         arg_min(w.body || i.body, (w.cost + i.cost, w.audit || i.audit)) AS body
  FROM ways w JOIN inserted i ON i.state = w.state AND i.reached IN (0, 3)
  JOIN (SELECT g, max(pos) + 1 AS pos FROM faults GROUP BY g) n ON n.g = w.g AND n.pos = w.pos
  GROUP BY w.g
), counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY g
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM named) o LEFT JOIN counted USING (g) LEFT JOIN ended USING (g)
"""
