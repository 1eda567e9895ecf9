"""One query per operator over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, fingerprints, language_id, lexical_search, license_scan, merkle, mixture, ngram_join, packing, quality_ledger, token_counts, toxicity, url_filter
from tidemark.llm.common import held_out, table
from tidemark.llm.pretokens import vocabulary

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
MIXTURE = mixture.Mixture(
    domains={"web": 0.4, "books": 0.3, "code": 0.2, "reference": 0.1},
    languages={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    share=0.9,
)
OVER = 1024
SEQUENCE = 2048
BEST = 50
CHAT_BUDGET, CHAT_HISTORY = 512, 128


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    return language_id.predict(docs, model, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = toxicity.predict(docs, model, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), [F.col("doc_id")])
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*base, (~quality_ledger.passes("base")).alias("base_failed"), quality_ledger.passes().alias("kept"), "failures")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS rid FROM documents),
grams AS (SELECT rid, unnest(range(0, greatest(len(ws) - 7, 0))) AS i, ws FROM w),
keyed AS (SELECT rid, i, array_to_string(ws[i + 1:i + 8], ' ') AS g FROM grams),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM keyed),
steps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS s FROM twice WHERE n > 1),
rep AS (SELECT rid, sum(s) AS n_repeat_words FROM steps GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_marks,
       length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, len(list_distinct(ws)) AS n_distinct,
       len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_marks > n_words)::INT
       + 16 * (10 * n_dup_lines > 5 * n_lines)::INT + 32 * (10 * n_upper > 5 * word_chars)::INT + 64 * (word_chars > 25 * n_words OR word_chars < 2 * n_words)::INT
       + 128 * (50 * n_distinct < n_words)::INT + 256 * (10 * n_stutter > 3 * n_words)::INT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failures = 0 AS kept, failures FROM f
"""


def domain() -> Column:
    """Domain of a document by the number in its source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    group = F.when(number == "", F.lit(-1)).otherwise(F.pmod(F.substring(number, -9, 9).cast("int"), F.lit(20)))
    return F.when(group < 0, "reference").when(group < 8, "web").when(group < 13, "books").when(group < 17, "code").otherwise("reference")


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = mixture.mix(docs, domain(), MIXTURE)
    return rows.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__epoch").cast("long").alias("epoch"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label(table(spark, sf_dir, "documents"), [F.col("doc_id")])


OP4_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hp AS (SELECT rid, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
       coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
ru AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM hp),
sy AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
       '^' || regexp_replace(translate(host || path, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', '0000000000abcdefghijklmnopqrstuvwxyz'), '[^a-z0./_-]', '~', 'g') || '$' AS s FROM ru),
ends AS (SELECT rid, ruled, s, unnest(range(2, length(s) + 1)) AS e FROM sy),
gr AS (SELECT rid, ruled, substr(s, e - k + 1, k) AS g FROM ends, (VALUES (1), (2), (3)) v(k) WHERE k <= e),
seen AS (SELECT g, length(g) AS k, substr(g, 1, length(g) - 1) AS c, count(*) FILTER (WHERE ruled = 'allow') AS na, count(*) FILTER (WHERE ruled = 'block') AS nr
         FROM gr WHERE ruled IS NOT NULL GROUP BY g HAVING count(*) >= CASE WHEN length(g) = 1 THEN 1 ELSE 3 END),
tot AS (SELECT k, c, sum(na) AS ta, sum(nr) AS tr FROM seen GROUP BY 1, 2),
t AS (SELECT seen.*, ta, tr FROM seen JOIN tot USING (k, c)),
p1 AS (SELECT g, (na + 2.0::DOUBLE * (1.0::DOUBLE / 34)) / (ta + 2.0::DOUBLE) AS pa, (nr + 2.0::DOUBLE * (1.0::DOUBLE / 34)) / (tr + 2.0::DOUBLE) AS pr, 0.0::DOUBLE AS below FROM t WHERE k = 1),
p2 AS (SELECT t.g, (na + 2.0::DOUBLE * p.pa) / (ta + 2.0::DOUBLE) AS pa, (nr + 2.0::DOUBLE * p.pr) / (tr + 2.0::DOUBLE) AS pr, ln(p.pa / p.pr) AS below FROM t JOIN p1 p ON p.g = substr(t.g, 2) WHERE k = 2),
p3 AS (SELECT t.g, (na + 2.0::DOUBLE * p.pa) / (ta + 2.0::DOUBLE) AS pa, (nr + 2.0::DOUBLE * p.pr) / (tr + 2.0::DOUBLE) AS pr, ln(p.pa / p.pr) AS below FROM t JOIN p2 p ON p.g = substr(t.g, 2) WHERE k = 3),
d AS (SELECT g, ln(pa / pr) - below AS delta FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
total AS (SELECT rid, sum(coalesce(delta, 0.0)) AS total FROM gr LEFT JOIN d USING (g) GROUP BY 1),
sc AS (SELECT sy.*, round(total / (length(s) - 1), 4) AS score FROM sy JOIN total USING (rid))
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN score >= (SELECT quantile_cont(score, 0.01) FROM sc WHERE ruled = 'allow') THEN 'allow' ELSE 'block' END AS verdict, score FROM sc
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), packing.Capacity(tokens=SEQUENCE))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n_chars: merkle.digest(*[merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(changed, leaf(F.try_add("n_chars", F.lit(1)))).alias("tampered")
    rows = merkle.manifest(docs, leaf(F.col("n_chars")), F.col("lang"), F.col("doc_id"), [F.col("doc_id"), tampered], fanout=2)
    again = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
checks AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS crc FROM documents, bits),
fields AS (SELECT doc_id, lang, crc, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, n_chars,
       coalesce(strlen(text) || ':' || text, '-') AS tail FROM checks),
leaves AS (SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
       CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM fields),
d AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS lvl, i, n, leaf AS dg FROM d UNION ALL
       SELECT lang, lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(dg, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 2),
subs AS (SELECT lang, dg AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, i, n, subroot AS dg FROM subs UNION ALL
       SELECT lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(dg, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2),
every AS (SELECT lang, lvl, i, dg, n FROM nodes),
steps AS (SELECT rid, e.lvl AS lvl, (d.i >> e.lvl) & 1 = 1 AS on_right, o.dg AS other FROM d JOIN every e ON e.lang IS NOT DISTINCT FROM d.lang AND e.i = d.i >> e.lvl AND e.n > 1
       LEFT JOIN every o ON o.lang IS NOT DISTINCT FROM e.lang AND o.lvl = e.lvl AND o.i = xor(e.i, 1)
       UNION ALL SELECT rid, 1000 + e.lvl, (s.i >> e.lvl) & 1 = 1, o.dg FROM d JOIN subs s ON s.lang IS NOT DISTINCT FROM d.lang JOIN tops e ON e.i = s.i >> e.lvl AND e.n > 1
       LEFT JOIN tops o ON o.lvl = e.lvl AND o.i = xor(e.i, 1)),
paths AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k, on_right, coalesce(other, '') AS other FROM steps),
proofs AS (SELECT rid, sha256(string_agg(other, '' ORDER BY k)) AS proof_sha256, count(*) AS steps FROM paths GROUP BY rid),
fold AS (SELECT rid, 0 AS k, coalesce(tampered, leaf) AS acc FROM d UNION ALL
       SELECT fold.rid, fold.k + 1, sha256(CASE WHEN on_right THEN other || acc ELSE acc || other END) FROM fold JOIN paths p ON p.rid = fold.rid AND p.k = fold.k + 1),
ends AS (SELECT rid, arg_max(acc, k) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT dg FROM tops WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT dg FROM tops WHERE n = 1) AS verified
FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang JOIN ends USING (rid) LEFT JOIN proofs USING (rid)
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical_search.search(docs, items, BEST)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
s AS (SELECT qid, item_id, rid, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM (SELECT qid, item_id, unnest(ts) AS term FROM q) JOIN tf USING (term) JOIN w USING (term), c GROUP BY qid, item_id, rid, tf.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST, rid) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, then reads everything back from windows, masks and counts of repeated turns."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    made = chat_format.windows(given.unionByName(own), CHAT_BUDGET, CHAT_HISTORY)
    read = made.withColumn("turns", chat_format.turns_of(F.col("formatted")))
    fresh = F.slice("turns", F.col("repeated") + 1, F.size("turns") - F.col("repeated"))
    spoken = F.transform(fresh, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    targets = chat_format.targets_of(F.col("formatted"), F.col("targets"))
    part = F.struct("window", F.array_join(spoken, "").alias("turns"), F.array_join(targets, "").alias("loss"))
    parts = read.groupBy("conv_id").agg(
        F.sum((F.size("turns") - F.col("repeated")).cast("long")).alias("n_turns"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    return parts.select(
        "conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )


OP13_SQL = r"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
       SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
t1 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS turns, 4 + len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{M}\p{N}]')) AS tokens
       FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text))),
t2 AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       max(CASE WHEN pos = 0 AND role = 'system' AND turns > 1 THEN tokens END) OVER (PARTITION BY conv_id) AS stok,
       17 + length(regexp_replace(regexp_replace(replace(role, '\', '\e'), '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\s\1', 'g'))
       + length(regexp_replace(regexp_replace(replace(text, '\', '\e'), '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\s\1', 'g')) AS chars FROM t1),
t3 AS (SELECT *, greatest(1, 384 - coalesce(stok, 0)) AS room, start // greatest(1, 384 - coalesce(stok, 0)) AS cell FROM t2),
t4 AS (SELECT *, 2 * cell + CASE WHEN start + tokens > (cell + 1) * room THEN 1 ELSE 0 END AS win FROM t3),
sp AS (SELECT conv_id, win, min(start) AS f, min(pos) AS first FROM t4 GROUP BY conv_id, win),
extra AS (SELECT sp.conv_id, sum(chars) AS chars FROM sp JOIN t4 ON t4.conv_id IS NOT DISTINCT FROM sp.conv_id AND first > 0
       AND ((t4.pos = 0 AND role = 'system') OR (NOT (t4.pos = 0 AND role = 'system') AND t4.pos < first AND t4.start >= f - 128)) GROUP BY sp.conv_id),
wins AS (SELECT conv_id, count(*) AS n FROM sp GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM t2 GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(g.chars + coalesce(extra.chars, 0) + 3 * wins.n AS BIGINT) AS formatted_chars
FROM g JOIN wins ON wins.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN extra ON extra.conv_id IS NOT DISTINCT FROM g.conv_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_ngram_jaccard_join, op3_toxicity, op4_url_filter, op5_token_counts, op6_quality_rules, op7_source_mixture,
        op8_fingerprints, op9_license_scan, op10_best_fit_packing, op11_merkle_manifest, op12_lexical_search, op13_chat_format,
    )
}
ORACLES = {"op4_url_filter": OP4_SQL, "op6_quality_rules": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_chat_format": OP13_SQL}
