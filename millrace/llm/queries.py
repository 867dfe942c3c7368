"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, html_text, jaccard, language, licenses, mixing, quality, repair, substrings, suffixes, toxicity, wand

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.quality(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM docs),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
  FROM words),
firsts AS (SELECT k, min(doc_id) AS first_id FROM windows WHERE n = 13 GROUP BY k),
repeated AS (SELECT v.doc_id, v.i FROM windows v JOIN firsts f ON v.k = f.k WHERE v.n = 13 AND v.doc_id > f.first_id),
marked AS (
  SELECT w.doc_id, w.i, w.word,
         max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.i = r.i),
kept AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
split AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
items AS (SELECT id, w, least(len(w), 13) AS n FROM split WHERE side = 'b' AND len(w) > 0),
item_windows AS (
  SELECT DISTINCT id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT n FROM items),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT s.doc_id, s.w, l.n, unnest(range(1, len(s.w) - l.n + 2)) AS i FROM split s, lengths l WHERE s.side = 'd' AND len(s.w) >= l.n)),
found AS (SELECT d.doc_id, d.n, d.i, b.id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.k = b.k),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(s.w), FALSE) AS contaminated
FROM split s LEFT JOIN hit h ON s.doc_id = h.doc_id LEFT JOIN ids i ON s.doc_id = i.doc_id WHERE s.side = 'd'
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
filled AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM filled),
draws AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
         CAST(floor(r.rate) AS BIGINT) + CASE WHEN CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM draws
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).drop("text_digest")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.union(extra)))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, len(text) + len(regexp_replace(text, '[^\\<#]', '', 'g')) + len(role) + len(regexp_replace(role, '[^\\<#\n]', '', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + len('### :') + 1 + len('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.with_empty(repair.report(repair.repair(repair.damaged(turns))), turns)


def _edited(state: str, code: str, cost: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{code}'}} END"


def _cheapest(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


OP11_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
hits AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * len(key)), lambda j: CASE WHEN j % 8 = 0 THEN CAST(ord(substr(key, CAST(j // 8 AS BIGINT) + 1, 1)) AS BIGINT) ELSE 0 END)),
                lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS h
  FROM named),
rows AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hits),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS initial
  FROM rows),
faults AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR) AS x
  FROM counts
  UNION ALL
  SELECT conv_id, i, {_cheapest(_edited("n", "D", "3"))} AS n,
         {_cheapest(_edited("s", "D", "3"), f"CASE WHEN may AND initial = 's' THEN {_edited('n', 'K', 'more')} END")} AS s,
         {_cheapest(_edited("u", "D", "3"), *[f"CASE WHEN may AND initial = 'u' THEN {_edited(p, 'K', 'more')} END" for p in ("n", "s", "x")], *[f"CASE WHEN may THEN {_edited(p, 'R', '2 + more')} END" for p in ("n", "s", "x")])} AS u,
         {_cheapest(_edited("x", "D", "3"), f"CASE WHEN may AND initial = 'a' THEN {_edited('u', 'K', 'more')} END", f"CASE WHEN may THEN {_edited('u', 'R', '2 + more')} END")} AS x
  FROM (
    SELECT d.conv_id, f.i, f.initial, f.fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS more, d.n, d.s,
           {_cheapest("d.u", *[_edited(f"d.{p}", "I", "2") for p in ("n", "s", "x")])} AS u, {_cheapest("d.x", _edited("d.u", "I", "2"), _edited("d.n", "II", "4"), _edited("d.s", "II", "4"))} AS x
    FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1)),
best AS (
  SELECT d.conv_id, {_cheapest("d.n", "d.x", _edited("d.u", "I", "2"), _edited("d.s", "II", "4"))} AS b
  FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i),
edits AS (SELECT conv_id, b.a AS audit, unnest(range(1, len(b.a) + 1)) AS j FROM best),
walked AS (
  SELECT conv_id, j, substr(audit, j, 1) AS e, len(regexp_replace(left(audit, j), 'I', '', 'g')) AS i, len(regexp_replace(left(audit, j), 'D', '', 'g')) AS m FROM edits),
told AS (
  SELECT w.conv_id, w.j, w.e, w.m, f.role, f.text, max(CASE WHEN w.e = 'K' AND w.m = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS system
  FROM walked w LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND w.e <> 'I'
  WHERE w.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM told GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
       coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = wand.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return wand.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH words AS (
  SELECT n, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS n, doc_id, text FROM documents)),
lengths AS (SELECT n, any_value(doc_id) AS doc_id, count(*) AS len FROM words GROUP BY n),
whole AS (SELECT count(*) AS docs, CAST(sum(len) AS BIGINT) AS terms FROM lengths),
freq AS (SELECT n, term, count(*) AS tf FROM words GROUP BY n, term),
weights AS (SELECT term, CAST(floor(1000 * ln(any_value(2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM freq, whole GROUP BY term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT i.item_id, f.n, any_value(l.doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * docs) // terms)))) AS BIGINT) AS score
  FROM items i JOIN freq f ON i.term = f.term JOIN weights t ON t.term = f.term JOIN lengths l ON l.n = f.n, whole
  GROUP BY i.item_id, f.n),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": op1_html_text,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op4_decontamination": op4_decontamination,
        "op5_mixing": op5_mixing,
        "op6_chat_format": op6_chat_format,
        "op8_license_scan": op8_license_scan,
        "op7_jaccard_join": op7_jaccard_join,
        "op3_substring_dedup": op3_substring_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_language_id": op12_language_id,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op5_mixing": OP5_SQL, "op6_chat_format": OP6_SQL, "op11_conversation_repair": OP11_SQL, "op13_ranked_search": OP13_SQL}
