"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.quality_llr import score_quality, trusted_ids

    return score_quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")), threshold=None)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.srs_ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=4, least=85, scale=100)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyforge.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.style_tree import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyforge.llm.bpe_matrix import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyforge.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.pii_crf import KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.repair import damage, plan, repaired_digest

    rows = damage(table(spark, sf_dir, "conversations"))
    return repaired_digest(rows, plan(rows))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.treap_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def lm_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_lm_score says besides the model's score, which SQL can restate."""
    out = op1_lm_score(spark, sf_dir).drop("score")
    return out.withColumn("base_score", F.round("base_score", 4))


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_quality_rules says besides the likelihood ratio and its verdict."""
    return op9_quality_rules(spark, sf_dir).drop("kept", "llr")


def pii_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_pii says besides the tagger's spans."""
    return op10_pii(spark, sf_dir).drop("spans")


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_style_tree": op2_style_tree,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_packing": op4_packing,
    "op5_nearest": op5_nearest,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_decontaminate": op11_decontaminate,
    "op12_repair": op12_repair,
    "op13_treap_search": op13_treap_search,
    "pipeline": pipeline,
    "lm_base_figures": lm_base_figures,
    "quality_base_figures": quality_base_figures,
    "pii_base_figures": pii_base_figures,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _crc(text: str) -> str:
    """CRC-32 of a text, bit by bit: a list element is a byte to be added, or -1 for a shift."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"""


_CRC = _crc("doc_id::VARCHAR")


def _repair_sql() -> str:
    """The edits in SQL, from the first turn on: for each state the least (cost, letters), with the turns written so far."""
    best = lambda *some: f"list_sort(list_filter([{', '.join(some)}], lambda x: x IS NOT NULL))[1]"

    def then(state: str, cost: str, letter: str, turn: str = "", only: str = "true") -> str:
        written = f"list_append({state}.x, {turn})" if turn else f"{state}.x"
        return f"CASE WHEN {state} IS NOT NULL AND {only} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'x': {written}}} END"

    put = lambda state, role: then(state, "5", "I", f"'{role}:'")
    cut, free = "(CASE WHEN fault = 't' THEN 5 ELSE 0 END)", "fault NOT IN ('b', 'd')"
    keep = lambda state, i: then(state, cut, "K", "role || ':' || text", f"{free} AND i = '{i}'")
    give = lambda state, role: then(state, f"1 + {cut}", "R", f"'{role}:' || text", free)
    two = [f(s, x) for s in ("s0", "s1", "e3") for f, x in ((keep, "u"), (give, "user"))]
    return rf"""WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 h AS (SELECT *, {_crc("key")} % 20 AS h FROM z),
 d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k, left(role, 1) AS i FROM d),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM k),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
 g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
 r AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 'x': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INT, a VARCHAR, x VARCHAR[]) AS s1, NULL::STRUCT(c INT, a VARCHAR, x VARCHAR[]) AS s2, NULL::STRUCT(c INT, a VARCHAR, x VARCHAR[]) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
  SELECT conv_id, k, {then("s0", "2", "D")}, {best(then("s1", "2", "D"), keep("s0", "s"))}, {best(then("e2", "2", "D"), *two)}, {best(then("e3", "2", "D"), keep("e2", "a"), give("e2", "assistant"))}
  FROM (SELECT *, {best("p2", put("s3", "user"))} AS e2, {best("s3", put("p2", "assistant"))} AS e3 FROM (
   SELECT r.conv_id, f.k, s0, s1, s3, {best("s2", put("s0", "user"), put("s1", "user"))} AS p2, f.role, f.text, f.i, f.fault FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1))),
 w AS (SELECT r.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated, coalesce(g.illegal, 0) AS illegal,
  s0, s3, {best("s2", put("s0", "user"), put("s1", "user"))} AS p2 FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.k = coalesce(g.n, 0)),
 v AS (SELECT *, {best("s0", "s3", put("p2", "assistant"))} AS b FROM w)
 SELECT conv_id, gaps, blank, duplicate, truncated, illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.x, chr(10))) AS repaired_sha256 FROM v"""


#: Kinds of personal data in order, with their patterns.
_KINDS = r"""(VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'))"""

#: The Jaccard join and what three operators say besides their models can be said in SQL over whole tables; the rest is
#: held against brute-force versions in tests (hashes, models, approximate search and tokenizers have no SQL form).
ORACLES: dict[str, str] = {
    "op7_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op11_decontaminate": rf"""WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE len({_ALNUM}) > 0),
 c AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(len(w) - least(10, len(w)) + 1)) AS k FROM b),
 i AS (SELECT DISTINCT item_id, l, array_to_string(w[k + 1:k + l], ' ') AS t FROM c), s AS (SELECT DISTINCT l FROM i),
 d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
 q AS (SELECT r, l, list_transform(range(len(w) - l + 1), lambda k: array_to_string(w[k + 1:k + l], ' ')) AS ts FROM d, s WHERE len(w) >= l),
 p AS (SELECT r, l, unnest(ts) AS t, unnest(range(len(ts))) AS k FROM q), h AS (SELECT r, item_id, p.l, k FROM p JOIN i ON i.t = p.t AND i.l = p.l),
 n AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(k, k + l)) AS x FROM h) GROUP BY r),
 a AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(a.n, 0) AS n_items, sha256(coalesce(a.ids, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
 FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN a ON a.r = d.r""",
    "op12_repair": _repair_sql(),
    "op13_treap_search": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_ALNUM})) AS t FROM benchmark),
 s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0), f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY r, doc_id, n, t),
 w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
 i AS (SELECT r, doc_id, f.t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * f.n * s.n) // s.l))) AS x FROM f JOIN w ON w.t = f.t, s),
 g AS (SELECT q, item_id, r, doc_id, sum(x)::BIGINT AS score FROM b JOIN i ON i.t = b.t GROUP BY q, item_id, r, doc_id HAVING sum(x) > 0)
 SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 50""",
    "lm_base_figures": f"""WITH d AS (SELECT doc_id, {_FOLDED} AS w, {_CRC} % 10 <> 0 AS training FROM documents),
 c AS (SELECT k, count(*) AS c FROM (SELECT unnest(w) AS k FROM d WHERE training) GROUP BY k UNION ALL SELECT NULL, count(*) FROM d WHERE training HAVING count(*) > 0),
 a AS (SELECT sum(c) AS n, count(*) AS v FROM c),
 t AS (SELECT doc_id, unnest(w) AS k, false AS is_end FROM d UNION ALL SELECT doc_id, NULL, true FROM d),
 s AS (SELECT t.doc_id, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (a.n + 0.1::DOUBLE * (a.v + 1)))) AS b FROM t JOIN a ON true LEFT JOIN c ON c.k IS NOT DISTINCT FROM t.k GROUP BY t.doc_id)
 SELECT d.doc_id, NOT d.training AS held_out, n_tokens, n_known, a.n::BIGINT AS train_tokens, round(b, 4) AS base_score FROM d JOIN s ON s.doc_id = d.doc_id, a""",
    "quality_base_figures": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, unnest(range(len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5), h AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM g),
 r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM h), p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id)
 SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b""",
    "pii_base_figures": rf"""WITH f AS (SELECT doc_id, k, kind, regexp_extract_all(coalesce(text, ''), p) AS ms, regexp_split_to_array(coalesce(text, ''), p) AS ps FROM documents, {_KINDS} AS kinds(k, kind, p)),
 u AS (SELECT doc_id, k, kind, unnest(range(len(ms))) AS i, ms, ps FROM f),
 m AS (SELECT doc_id, k, kind, ms[i + 1] AS m, (list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0))::BIGINT AS s FROM u),
 n AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS r FROM m),
 g AS (SELECT * FROM n WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(right(ltrim(x, '0'), 3), '') AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(r)), lambda i: CASE WHEN i % 2 = 0 THEN r[i + 1]::INT ELSE 2 * r[i + 1]::INT - 9 * (r[i + 1]::INT > 4)::INT END)) % 10 = 0
  ELSE length(n) BETWEEN 9 AND 15 END)
 SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) FILTER (kind IS NOT NULL), '')) AS base_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
}
