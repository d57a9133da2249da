"""One query for each operator, over its whole table, with its SQL twin where there is one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, language, mixing, pii, whitening
from tidewatch.llm.collocations import ranked_collocations
from tidewatch.llm.common import table
from tidewatch.llm.decontaminate import phrase_matches, words_hit
from tidewatch.llm.line_dedup import drop_shared_lines
from tidewatch.llm.pieces import encode_texts
from tidewatch.llm.quality import judge, train
from tidewatch.llm.secrets import KINDS, find_secrets
from tidewatch.llm.simhash import near_duplicate_groups
from tidewatch.llm.url_filter import judge_urls, rule_table


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return encoded.select("doc_id", "n_tokens", "n_byte_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrase_matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"].cast("string"))))
    hit = found.select("doc_id", "n_words", words_hit(F.col("matches")).alias("n_hit"), items.alias("items"), F.size("near").cast("long").alias("n_near"))
    return hit.select("n_near", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items))
), hits AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), frequencies AS (
  SELECT word, count(*) AS n FROM tokens GROUP BY word
), rare AS (
  SELECT item_id, word, count(*) OVER (PARTITION BY item_id) AS needed FROM (
    SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY n, word) AS k FROM (SELECT DISTINCT item_id, unnest(w) AS word FROM b) JOIN frequencies USING (word)
  ) WHERE k <= 3
), places AS (
  SELECT doc_id, item_id, word, needed, p FROM tokens JOIN rare USING (word)
), nearby AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT e.doc_id, e.item_id FROM places e JOIN places o ON e.doc_id = o.doc_id AND e.item_id = o.item_id AND o.p <= e.p AND o.p > e.p - 20
    GROUP BY e.doc_id, e.item_id, e.p, e.needed HAVING count(DISTINCT o.word) = e.needed
  ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""


#: Fixed rules of the URL query: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, URL_RULES))
    return judged.withColumnRenamed("page", "page_id")


OP8_SQL = """
WITH rules(rule_host, rule_path, action) AS (VALUES %s),
parts AS (
  SELECT page_id, url, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), fits AS (
  SELECT r, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM named LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
""" % ", ".join(map(repr, URL_RULES))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*map(F.lit, KINDS))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(F.col("doc").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = language.held_out(F.col("doc_id"))
    model = language.train(docs, ~apart & F.col("doc_id").isNotNull())
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", apart.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*map(F.lit, pii.KINDS))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


#: The conversation that the chat query adds: both texts are full of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    formatted = chat.format_conversations(spark, rows.unionByName(more))

    @F.pandas_udf("string")
    def read_back(texts: pd.Series) -> pd.Series:
        return pd.Series(["".join(f"{role}\n{text}\n" for role, text in chat.parse(t)) for t in texts], dtype=object)

    return formatted.select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2(read_back("formatted"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + (length(role) - length(replace(role, '\', ''))) AS role_chars,
    length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS text_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    n, explained, error = (None, [], None) if model is None else (model.n, [float(v) / model.trace if model.trace else None for v in model.values], model.identity_error)
    share = F.get(F.array(*(F.lit(e).cast("double") for e in explained)).cast("array<double>"), F.col("component_") - 1)
    return whitening.whiten(rows, model).select(
        "vec_id", F.col("component_").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation_ AS bigint)").alias("deviation"),
        F.col("whitened_").alias("whitened"), share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f1 AS (
  SELECT lang, x, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL
), f2 AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, count(*)::HUGEINT AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*)::HUGEINT AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, x || ' ' || y AS phrase, c.f AS a, 1 AS k, p.f AS l, q.f AS r FROM f2 c JOIN f1 p USING (lang, x) JOIN (SELECT lang, x AS y, f FROM f1) q USING (lang, y)
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND t.x = c.x AND t.y = c.y AND 100 * t.f >= 50 * c.f)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND t.y = c.x AND t.z = c.y AND 100 * t.f >= 50 * c.f)
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, c.f, 1, p.f, q.f FROM f3 c JOIN f1 p USING (lang, x) JOIN (SELECT lang, x AS y, y AS z, f FROM f2) q USING (lang, y, z)
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, c.f, 2, p.f, q.f FROM f3 c JOIN f2 p USING (lang, x, y) JOIN (SELECT lang, x AS z, f FROM f1) q USING (lang, z)
), scored AS (
  SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts
), least_cut AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM least_cut JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sizes GROUP BY source
), levels AS (
  SELECT *, 2.0 * source_size AS cap, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER full_first, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER full_first, 0)) AS level
  FROM totals WINDOW full_first AS (ORDER BY 2.0 * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, i, CASE WHEN min(CASE WHEN cap > level * w THEN cap / w END) OVER () <= cap / w THEN first_value(level) OVER (ORDER BY NOT cap > level * w, cap / w, i) * w ELSE cap END AS target FROM levels
), laid AS (
  SELECT *, row_number() OVER () AS row_id, CAST(sum(size) OVER (PARTITION BY i, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM (
    SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % greatest(CAST(ceil(source_size / 524288) AS BIGINT), 1) AS shard FROM (
      SELECT doc_id, size, copy, i, source_size, target, md5('13|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || copy) AS draw
      FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) AS copy FROM sizes) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE size > 0))
), parts AS (
  SELECT i, shard, target, source_size, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / 32) AS BIGINT) AS blocks FROM laid GROUP BY ALL
), by_source AS (
  SELECT i, target, CAST(2 * sum(blocks) AS BIGINT) AS room, CAST(floor(sum(source_size) OVER () * 1.5 / 32 + 0.5) AS BIGINT) AS seats FROM parts GROUP BY i, target, source_size
), source_quotas AS (
  SELECT i, count(*) AS quota FROM (SELECT i, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i, k) AS rank FROM (SELECT *, unnest(range(0, room)) AS k FROM by_source)) WHERE rank <= seats GROUP BY i
), quotas AS (
  SELECT i, shard, blocks, count(*) AS quota FROM (
    SELECT i, shard, blocks, quota, row_number() OVER (PARTITION BY i ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS rank FROM (SELECT *, unnest(range(0, 2 * blocks)) AS k FROM parts JOIN source_quotas USING (i))
  ) WHERE rank <= quota GROUP BY ALL
), chosen AS (
  SELECT i, shard, block FROM (
    SELECT *, row_number() OVER (PARTITION BY i, shard ORDER BY md5('13|' || shard || '|' || block), block) AS rank FROM (SELECT i, shard, quota % blocks AS rest, unnest(range(0, blocks)) AS block FROM quotas)
  ) WHERE rank <= rest
), extra AS (
  SELECT row_id, sum(least(start + size, (block + 1) * 32) - greatest(start, block * 32)) AS extra
  FROM (SELECT *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS block FROM laid) JOIN chosen USING (i, shard, block) GROUP BY row_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(quota // blocks, 0) * size + coalesce(extra, 0) AS BIGINT) AS taken
FROM laid LEFT JOIN quotas USING (i, shard) LEFT JOIN extra USING (row_id)
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE size = 0
"""
