"""DuckDB SQL that restates the queries over the same tables."""

from __future__ import annotations

from tallyforge.plans.codebook import PROMPTS

# Fixed values, stated apart from the engine's: a wrong constant there must not agree with itself here.
Z95 = 1.959963984540054
INCIVILITY = {0: "Civil", 1: "Vulgar/Profane", 2: "Attacks", 3: "Aspersions"}
INTOLERANCE = {
    0: "Tolerant", 1: "Threats to Rights", 2: "Political Intolerance", 3: "Racism", 4: "Social Intolerance", 5: "Gender/Sexual Intolerance",
    6: "Religious Intolerance", 7: "Offensive Stereotypes", 8: "Violent Threats", 9: "Ableism",
}
DIMENSIONS = {"incivility": INCIVILITY, "intolerance": INTOLERANCE}
ANSWERS = {"incivility": ("Incivility", "Civil", "Uncivil"), "intolerance": ("Intolerance", "Tolerant", "Intolerant"), "hateful": ("Hatefulness", "Neutral", "Hateful")}
TASK_LABELS = {"coarse": ("hateful",), "fine": ("incivility", "intolerance"), "joint": ("incivility", "intolerance", "hateful")}

ANN = """ann AS (SELECT event_id % 997 AS id, 'Annotator_' || (user_id % 3 + 1) AS annotator, event_id AS seq,
 'item ' || (event_id % 997) AS text, CASE WHEN event_type IN ('error','purchase') THEN 1 ELSE 0 END AS label_hateful,
 CASE CAST(k AS INT) % 5 WHEN 2 THEN '1' WHEN 3 THEN '1,2' WHEN 4 THEN '3' ELSE '0' END AS label_incivility,
 array_to_string(list_sort(list_distinct(regexp_extract_all(k,'([0-9])',1))),',') AS label_intolerance
 FROM (SELECT *, regexp_extract(props,'([0-9]+)',1) AS k FROM events)),
 ded AS (SELECT * FROM ann QUALIFY row_number() OVER (PARTITION BY annotator, id ORDER BY seq DESC) = 1),
 bin AS (SELECT *, CASE WHEN contains(label_incivility,'0') THEN 0 ELSE 1 END AS label_incivility_bin,
 CASE WHEN contains(label_intolerance,'0') THEN 0 ELSE 1 END AS label_intolerance_bin FROM ded)"""

GOLD = """gold AS (SELECT d.doc_id AS id, text, 'img/' || lpad(CAST(d.doc_id AS VARCHAR),5,'0') || '.png' AS img,
 CASE d.doc_id % 5 WHEN 0 THEN 'dev_seen' WHEN 1 THEN 'dev_unseen' WHEN 2 THEN 'test_seen' WHEN 3 THEN 'test_unseen' ELSE 'train' END AS split,
 toxic AS label_hateful, 1 - quality AS label_incivility,
 CASE WHEN n_chars % 3 = 0 OR (toxic = 1 AND n_chars % 2 = 0) THEN 1 ELSE 0 END AS label_intolerance
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

PRED = """raw AS (SELECT o_orderkey AS id, o_orderpriority, CAST(o_orderstatus = 'F' AS INT) AS label_hateful,
 CAST(o_totalprice > 100000 AS INT) AS label_incivility, CAST(o_custkey % 3 = 0 AS INT) AS label_intolerance,
 CASE o_orderpriority WHEN '1-URGENT' THEN '  Hateful ' WHEN '2-HIGH' THEN 'Neutral.' WHEN '3-MEDIUM' THEN 'This is NOT hateful'
  WHEN '4-NOT SPECIFIED' THEN 'neutral' ELSE 'cannot say' END AS output_coarse,
 CASE o_orderkey % 4 WHEN 0 THEN 'Incivility: Civil' WHEN 1 THEN 'Incivility:Uncivil' WHEN 2 THEN 'incivility: uncivil' ELSE 'n/a' END || ', ' ||
 CASE o_custkey % 5 WHEN 0 THEN 'Intolerance: Intolerant' WHEN 1 THEN 'intolerance:intolerant' WHEN 2 THEN 'none' ELSE 'Intolerance: Tolerant' END || ', ' ||
 CASE o_orderkey % 3 WHEN 0 THEN 'Hatefulness: Hateful' WHEN 1 THEN 'hatefulness:neutral' ELSE 'Hatefulness:  Hateful' END AS output_joint FROM orders),
 low AS (SELECT *, trim(regexp_replace(lower(output_coarse), '\\s+', ' ', 'g')) AS c, lower(output_joint) AS j FROM raw),
 coarse AS (SELECT id, o_orderpriority, 'hateful' AS category, label_hateful AS y,
  CASE WHEN contains(c,'hateful') THEN 1 WHEN contains(c,'neutral') THEN 0 ELSE -1 END AS p FROM low),
 fine AS (SELECT id, o_orderpriority, 'incivility' AS category, label_incivility AS y,
  CASE WHEN contains(j,'incivility: civil') OR contains(j,'incivility:civil') THEN 0
       WHEN contains(j,'incivility: uncivil') OR contains(j,'incivility:uncivil') THEN 1 ELSE -1 END AS p FROM low
  UNION ALL SELECT id, o_orderpriority, 'intolerance', label_intolerance,
  CASE WHEN contains(j,'intolerance: tolerant') OR contains(j,'intolerance:tolerant') THEN 0
       WHEN contains(j,'intolerance: intolerant') OR contains(j,'intolerance:intolerant') THEN 1 ELSE -1 END FROM low),
 joint_ AS (SELECT * FROM fine UNION ALL SELECT id, o_orderpriority, 'hateful', label_hateful,
  CASE WHEN contains(j,'hatefulness: neutral') OR contains(j,'hatefulness:neutral') THEN 0
       WHEN contains(j,'hatefulness: hateful') OR contains(j,'hatefulness:hateful') THEN 1 ELSE -1 END FROM low)"""

CELLS = """count(*) AS n, count(*) FILTER (p = -1) AS n_invalid, count(*) FILTER (y = 1) AS n1,
 count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn,
 count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def metrics(source: str, by: str, exclude: bool = False) -> str:
    total, s1 = ("(n - n_invalid)", "(tp + fn)") if exclude else ("n", "n1")
    return f"""c AS (SELECT {by}, {CELLS} FROM {source} GROUP BY {by}),
 r AS (SELECT *, {total} AS t, {s1} AS s1, {total} - {s1} AS s0, {ratio('tp', '(tp + fp)')} AS p1, {ratio('tp', s1)} AS r1,
  {ratio('tn', '(tn + fn)')} AS p0, {ratio('tn', f'({total} - {s1})')} AS r0 FROM c),
 f AS (SELECT *, {ratio('2 * p1 * r1', '(p1 + r1)')} AS f1_1, {ratio('2 * p0 * r0', '(p0 + r0)')} AS f1_0 FROM r),
 m AS (SELECT {by}, n, n - n_invalid AS valid_samples, {ratio('tp + tn', 't')} AS accuracy, {ratio('p0 * s0 + p1 * s1', 't')} AS precision,
  {ratio('r0 * s0 + r1 * s1', 't')} AS recall, {ratio('f1_0 * s0 + f1_1 * s1', 't')} AS f1, n_invalid / CAST(n AS DOUBLE) AS invalid_rate FROM f)"""


def bias(source: str, by: str) -> str:
    return f"""WITH {PRED}, c AS (SELECT {by}, {CELLS} FROM {source} GROUP BY {by}),
 b AS (SELECT *, {ratio('fp', '(fp + tn)')} AS fpr, {ratio('fn', '(fn + tp)')} AS fnr FROM c)
 SELECT {by}, n, tp, tn, fp, fn, {ratio('tp + tn', 'n')} AS accuracy, {ratio('tp', 'n1')} AS accuracy_pos, {ratio('tn', '(n - n1)')} AS accuracy_neg,
 fpr, fnr, fnr - fpr AS error_difference FROM b"""


def column(prefix: str, name: str) -> str:
    return f"{prefix}_{name.replace(' ', '_').replace('/', '_')}"


def codes(name: str) -> str:
    return f"flat AS (SELECT id, label_hateful, unnest(string_split(label_{name}, ','))::INT AS code, len(string_split(label_{name}, ',')) AS k FROM bin)"


def agreement() -> str:
    one = " UNION ALL ".join(
        f"SELECT '{c}' AS label, a.annotator AS annotator_a, b.annotator AS annotator_b, a.{c} AS x, b.{c} AS z FROM bin a JOIN bin b ON a.id = b.id AND a.annotator < b.annotator"
        for c in ("label_hateful", "label_incivility_bin", "label_intolerance_bin")
    )
    return f"""WITH {ANN}, met AS ({one}), s AS (SELECT label, annotator_a, annotator_b, count(*) AS n, count(*) FILTER (x = z) AS same,
 count(*) FILTER (x = 1) AS a1, count(*) FILTER (z = 1) AS b1 FROM met GROUP BY ALL),
 e AS (SELECT *, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS chance, same / n AS seen FROM s),
 pairs AS (SELECT label, annotator_a, annotator_b, n, seen AS agreement, CASE WHEN chance < 1 THEN (seen - chance) / (1 - chance) END AS kappa FROM e)"""


PHI = "(n11::DOUBLE * n00 - n10::DOUBLE * n01) / nullif(sqrt((n11 + n10)::DOUBLE * (n01 + n00)) * sqrt((n11 + n01)::DOUBLE * (n10 + n00)), 0)"
HYPOTHESES = {
    "intolerance": "label_intolerance = 1",
    "incivility": "label_incivility = 1",
    "incivility_or_intolerance": "label_incivility = 1 OR label_intolerance = 1",
    "incivility_and_intolerance": "label_incivility = 1 AND label_intolerance = 1",
}


def hypothesis(select: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{k}' AS hypothesis, CAST({c} AS INT) AS x, label_hateful AS y FROM gold" for k, c in HYPOTHESES.items())
    return f"""WITH {GOLD}, h AS ({rows}), t AS (SELECT hypothesis, count(*) FILTER (x=1 AND y=1) AS n11, count(*) FILTER (x=1 AND y=0) AS n10,
 count(*) FILTER (x=0 AND y=1) AS n01, count(*) FILTER (x=0 AND y=0) AS n00, count(*) AS n FROM h GROUP BY hypothesis) SELECT hypothesis, n, {select} FROM t"""


def votes() -> str:
    """Items with a modal hateful label and their majority categories in long form."""
    part = " UNION ALL ".join(
        f"SELECT i.id, '{column(d, n)}' AS category, CASE WHEN count(*) FILTER (list_contains(string_split(b.label_{d}, ','), '{k}')) >= 2 THEN 1 ELSE 0 END AS v FROM items i JOIN bin b ON i.id = b.id GROUP BY i.id"
        for d, names in DIMENSIONS.items()
        for k, n in names.items()
    )
    return f"""WITH {ANN}, items AS (SELECT id, CASE WHEN count(*) FILTER (label_hateful = 1) > count(*) FILTER (label_hateful = 0) THEN 1 ELSE 0 END AS y FROM bin GROUP BY id),
 v AS ({part}), t AS (SELECT category, count(*) FILTER (v=1 AND y=1) AS n11, count(*) FILTER (v=1 AND y=0) AS n10, count(*) FILTER (v=0 AND y=1) AS n01,
 count(*) FILTER (v=0 AND y=0) AS n00 FROM v JOIN items USING (id) GROUP BY category), k AS (SELECT category, n11 + n10 AS n, n11 AS k, n11 / (n11 + n10) AS rate, {PHI} AS phi FROM t WHERE n11 + n10 > 0)"""


def soft(name: str, names: dict[int, str]) -> str:
    each = ", ".join(f"coalesce(sum(CASE WHEN code = {k} THEN 1.0::DOUBLE / k END), 0) AS s{k}" for k in names)
    total = "sum(1.0::DOUBLE / k)"
    out = ", ".join(f"round(s{k} / t, 9) AS {column(name, n)}" for k, n in names.items())
    return f"WITH {ANN}, {codes(name)}, w AS (SELECT id, {each}, {total} AS t FROM flat GROUP BY id) SELECT id, {out} FROM w"


# The order of a split's seed: of the bucket (three hexadecimal digits of the id's digest) as mixed by the seed, the digest and the id.
BUCKET = "(('0x' || left(md5(id::VARCHAR), 3))::BIGINT)"
MIXED = f"((({BUCKET} + 1) * ((({{seed}})::BIGINT * 1000003 + 40503) % 2147483647)) % 2147483647)"
SPLIT = f"""SELECT *, row_number() OVER (PARTITION BY {{by}} split ORDER BY (({MIXED} * {MIXED}) % 2147483647 * 48271 + {BUCKET}) % 2147483647, {BUCKET}, md5(id::VARCHAR), id) AS r,
 count(*) OVER (PARTITION BY {{by}} split) AS n FROM {{source}}"""
# The same where each seed orders all rows anew, by the digest of id and seed.
APART = """SELECT *, row_number() OVER (PARTITION BY {by} split ORDER BY md5(id || '-' || {seed}), id) AS r,
 count(*) OVER (PARTITION BY {by} split) AS n FROM {source}"""
PART = "CASE WHEN r <= (2 * ((3 * n + 9) // 10) + 2) // 3 THEN 'test' WHEN r <= (3 * n + 9) // 10 THEN 'validation' ELSE 'train' END AS part"


def balance(by: str) -> str:
    own = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {own}'{c}' AS label, avg({c}) FILTER (part = 'train') AS train, avg({c}) FILTER (part = 'validation') AS validation, avg({c}) FILTER (part = 'test') AS test FROM parts {'GROUP BY ' + by if by else ''}"
        for c in ("label_hateful", "label_incivility", "label_intolerance")
    )


def wilson(rounded: bool = True) -> str:
    z2 = repr(Z95 * Z95)
    middle = f"(rate + {z2} / (2 * n)) / (1 + {z2} / n)"
    half = f"{Z95!r} * sqrt(rate * (1 - rate) / n + {z2} / (4 * n * n)) / (1 + {z2} / n)"
    low, high = f"{middle} - {half}", f"{middle} + {half}"
    return f"round({low}, 9) AS low, round({high}, 9) AS high" if rounded else f"{low} AS low, {high} AS high"


def titled() -> str:
    """A category's name as a title: every word's first letter upper case, the others lower case."""
    bare = "replace(regexp_replace(category, '^(incivility|intolerance)_', ''), '_', ' ')"
    return f"array_to_string(list_transform(string_split({bare}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


def built() -> str:
    """Majority labels with the catalogue's image and split, and the seed of 20 with the least drift."""
    tried = APART.format(by="seed,", seed="seed", source="g")
    return f"""WITH {ANN}, {GOLD}, v AS (SELECT id, text, CAST(avg(label_hateful) >= 0.5 AS INT) AS label_hateful, CAST(avg(label_incivility_bin) >= 0.5 AS INT) AS label_incivility,
 CAST(avg(label_intolerance_bin) >= 0.5 AS INT) AS label_intolerance FROM bin GROUP BY id, text), known AS (SELECT v.*, gold.img, gold.split FROM v LEFT JOIN gold ON v.id = gold.id),
 g AS (SELECT known.*, x.seed FROM known, (SELECT unnest(range(20))::INT AS seed) x), t AS ({tried}), tried AS (SELECT *, {PART} FROM t),
 b AS ({balance('seed').replace('FROM parts', 'FROM tried')}), best AS (SELECT seed FROM (SELECT seed, round(avg((abs(validation - train) + abs(test - train)) / 2), 9) AS drift FROM b GROUP BY seed) ORDER BY drift, seed LIMIT 1)"""


def newton(pattern: str, names: list[str], rounds: int = 12) -> str:
    """CTEs of a logistic regression over `pattern` (y, w, x: values and a 1): b, the coefficients, inv, the inverse of X'WX,
    and fit, the log likelihood. Every step sums X'WX and the gradient and eliminates."""
    q = len(names) + 1
    rows = f"range(1, {q + 1})"
    parts = [pattern, f"b0 AS MATERIALIZED (SELECT list_transform({rows}, lambda i: 0.0::DOUBLE) AS b)"]
    for t in range(1, rounds + 2):
        last = t > rounds
        right = f"SELECT i, {q} + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM ij" if last else f"SELECT i, {q + 1}, sum(w * (y - p) * x[i]) FROM e{t}, (SELECT unnest({rows}) AS i) GROUP BY i"
        parts.append(f"e{t} AS MATERIALIZED (SELECT y, w, x, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM pattern, b{t - 1})")
        parts.append(f"h{t} AS MATERIALIZED (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(w * p * (1 - p) * x[i] * x[j]) AS s FROM e{t}, ij GROUP BY i, j UNION ALL {right}) GROUP BY i)")
        parts.append(f"m{t}_0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM h{t})")
        for k in range(1, q + 1):
            parts.append(f"m{t}_{k} AS MATERIALIZED (SELECT list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / m[{k}][{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] / m[{k}][{k}] * m[{k}][j]) END) AS m FROM m{t}_{k - 1})")
        if not last:
            parts.append(f"b{t} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v + m[i][{q + 1}]) AS b FROM b{t - 1}, m{t}_{q})")
    parts.insert(1, f"ij AS MATERIALIZED (SELECT i, j FROM (SELECT unnest({rows}) AS i), (SELECT unnest({rows}) AS j))")
    terms = ", ".join(quoted(n) for n in [*names, "intercept"])
    parts.append(f"wald AS (SELECT unnest([{terms}]) AS term, unnest(b) AS b, unnest(list_transform({rows}, lambda i: sqrt(m[i][{q} + i]))) AS se FROM b{rounds}, m{rounds + 1}_{q})")
    parts.append(f"fit AS (SELECT sum(w) AS n, sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) AS l, sum(w * y) / sum(w) AS s FROM e{rounds + 1})")
    return ", ".join(parts)


def soft_all() -> str:
    """Soft labels of both dimensions with the majority label of each item."""
    both, columns = [], []
    for name in DIMENSIONS:
        names = DIMENSIONS[name]
        cells = ", ".join(f"coalesce(sum(1.0 / n) FILTER (code = {k}), 0) AS s{k}" for k in names)
        whole = f"coalesce(sum(1.0 / n) FILTER (code IN ({', '.join(map(str, names))})), 0)"
        both.append(f"{name}_ AS (SELECT id, {cells}, {whole} AS t FROM (SELECT id, len(c) AS n, unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS code FROM (SELECT id, list_transform(list_filter(string_split(coalesce(label_{name}, ''), ','), lambda x: x <> ''), lambda x: x::INT) AS c FROM ded)) GROUP BY id)")
        columns += [f"coalesce({name}_.s{k} / nullif({name}_.t, 0), 0) AS {column(name, n)}" for k, n in names.items()]
    return f"{', '.join(both)}, h AS (SELECT id, CAST(avg(label_hateful) >= 0.5 AS INT) AS hateful FROM ded GROUP BY id), soft AS (SELECT h.id, h.hateful, {', '.join(columns)} FROM h {' '.join(f'JOIN {d}_ ON {d}_.id = h.id' for d in DIMENSIONS)})"


def shares() -> str:
    """Counts and shares of every code, also those never given, in order of dimension and code."""
    parts = []
    for d, names in DIMENSIONS.items():
        book = ", ".join(f"({k})" for k in names)
        counts = f"(SELECT unnest(string_split(label_{d}, ','))::INT AS code, 1 AS one FROM ded WHERE label_{d} <> '')"
        parts.append(f"SELECT '{d}' AS \"group\", b.code, count(c.one) AS n FROM (VALUES {book}) AS b(code) LEFT JOIN {counts} c ON c.code = b.code GROUP BY b.code")
    return f"WITH {ANN}, s AS ({' UNION ALL '.join(parts)}) SELECT (row_number() OVER (ORDER BY \"group\", code))::INT AS place, \"group\", code, n, n / sum(n) OVER (PARTITION BY \"group\")::DOUBLE AS share FROM s"


def regression(names: list[str]) -> str:
    return f"WITH {ANN}, {soft_all()}, " + newton(f"pattern AS MATERIALIZED (SELECT hateful::DOUBLE AS y, count(*) AS w, [{', '.join(names)}, 1.0] AS x FROM soft GROUP BY y, x)", names)


SOFT = [column(d, n) for d, names in DIMENSIONS.items() for k, n in names.items()]
TERMS = [column(d, n) for d, names in DIMENSIONS.items() for k, n in names.items() if k]
WALD = f"SELECT term, round(b, 6) AS coefficient, round(se, 6) AS se, round(b / se, 6) AS z, round(exp(b), 6) AS odds_ratio, round(exp(b - {Z95!r} * se), 6) AS low, round(exp(b + {Z95!r} * se), 6) AS high FROM wald"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def messages(task: str, kind: str) -> str:
    system, user = PROMPTS[task]
    prompt = f"replace({quoted(user)}, '{{}}', coalesce(text, ''))"
    text, image = ("input_text", "input_image") if kind == "api" else ("text", "image")
    img = "'data:image/png;base64,' || img" if kind == "api" else "img"
    parts = [(0, "system", 0, text, quoted(system), "NULL")]
    user_parts = [(image, "NULL", img), (text, prompt, "NULL")]
    for k, (t, x, i) in enumerate(reversed(user_parts) if kind == "api" else user_parts):
        parts.append((1, "user", k, t, x, i))
    if kind == "train":
        word = lambda k: f"CASE WHEN label_{k} = 1 THEN '{ANSWERS[k][2]}' ELSE '{ANSWERS[k][1]}' END"
        labels = TASK_LABELS[task]
        answer = word(labels[0]) if len(labels) == 1 else " || ', ' || ".join(f"'{ANSWERS[k][0]}: ' || {word(k)}" for k in labels)
        parts.append((2, "assistant", 0, "text", answer, "NULL"))
    rows = " UNION ALL ".join(f"SELECT id, {n} AS turn, '{r}' AS role, {k} AS part, '{t}' AS type, {x} AS text, {i}::VARCHAR AS image FROM gold" for n, r, k, t, x, i in parts)
    return f"WITH {GOLD} {rows}"


def value_map(names: dict[int, str]) -> str:
    return "MAP {" + ", ".join(f"{k}: {quoted(v)}" for k, v in names.items()) + "}"


METRICS = "n, valid_samples, accuracy, precision, recall, f1, invalid_rate"
KEEP = "id, annotator, seq, text, label_hateful, label_incivility, label_intolerance"

ORACLES: dict[str, str] = {
    "coarse_eval_metrics": f"WITH {PRED}, {metrics('coarse', 'category')} SELECT category, {METRICS} FROM m",
    "coarse_eval_metrics_valid_only": f"WITH {PRED}, {metrics('coarse', 'category', True)} SELECT category, {METRICS} FROM m",
    "fine_eval_metrics": f"WITH {PRED}, {metrics('fine', 'category')} SELECT category, {METRICS} FROM m",
    "joint_eval_metrics": f"WITH {PRED}, {metrics('joint_', 'category')} SELECT category, {METRICS} FROM m",
    "eval_macro_average": f"WITH {PRED}, {metrics('joint_', 'category')} SELECT round(avg(accuracy), 9) AS accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, round(avg(invalid_rate), 9) AS invalid_rate FROM m",
    "confusion_matrix_normalized": f"WITH {PRED}, k AS (SELECT category, y, p, count(*) AS n FROM joint_ GROUP BY ALL) SELECT category, y, p, n, n / sum(n) OVER (PARTITION BY category, y) AS rate FROM k",
    "bias_table": bias("joint_", "category"),
    "bias_by_group": bias("joint_", "o_orderpriority, category"),
    "annotator_coverage": f"WITH {ANN} SELECT annotator, count(DISTINCT id) AS n_items, count(DISTINCT id) = 997 AS complete FROM ann GROUP BY annotator",
    "exclusivity_violations": f"WITH {ANN} SELECT 'label_incivility' AS label, count(*) FILTER (list_contains(string_split(label_incivility, ','), '0') AND contains(label_incivility, ',')) AS n_violations FROM ann UNION ALL SELECT 'label_intolerance', count(*) FILTER (list_contains(string_split(label_intolerance, ','), '0') AND contains(label_intolerance, ',')) FROM ann",
    "dedupe_keep_last": f"WITH {ANN} SELECT {KEEP} FROM ded",
    "dedupe_keep_first": "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "duplicate_count": "SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents",
    "binarized_labels": f"WITH {ANN} SELECT id, annotator, label_incivility_bin, label_intolerance_bin FROM bin",
    "majority_mean": f"WITH {ANN} SELECT id, text, CAST(avg(label_hateful) >= 0.5 AS INT) AS hateful, CAST(avg(label_incivility_bin) >= 0.5 AS INT) AS incivility, CAST(avg(label_intolerance_bin) >= 0.5 AS INT) AS intolerance FROM bin GROUP BY id, text",
    "majority_mode": f"WITH {ANN} SELECT id, " + ", ".join(f"CASE WHEN count(*) FILTER ({c} = 1) > count(*) FILTER ({c} = 0) THEN 1 ELSE 0 END AS {o}" for c, o in (("label_hateful", "hateful"), ("label_incivility_bin", "incivility"), ("label_intolerance_bin", "intolerance"))) + " FROM bin GROUP BY id",
    "majority_multilabel": f"WITH {ANN}, {codes('intolerance')} SELECT id, " + ", ".join(f"CASE WHEN count(*) FILTER (code = {k}) >= 2 THEN 1 ELSE 0 END AS {column('intolerance', n)}" for k, n in INTOLERANCE.items()) + " FROM flat GROUP BY id",
    "soft_label_distribution": soft("intolerance", INTOLERANCE),
    "label_frequency_share": f"WITH {ANN}, {codes('incivility')}, f AS (SELECT code, count(*) AS n FROM flat GROUP BY code), b AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {quoted(n.replace(' ', '_').replace('/', '_'))})" for k, n in INCIVILITY.items()) + ") AS x(code, name)) SELECT b.code, name, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS share FROM b LEFT JOIN f ON b.code = f.code",
    "pairwise_agreement_kappa": agreement() + " SELECT label, annotator_a, annotator_b, n, agreement, kappa FROM pairs",
    "agreement_summary": agreement() + " SELECT label, count(*) AS n_pairs, round(avg(agreement), 9) AS agreement_mean, round(stddev_pop(agreement), 9) AS agreement_std, round(avg(kappa), 9) AS kappa_mean, round(stddev_pop(kappa), 9) AS kappa_std FROM pairs GROUP BY label",
    "disagreement_items": f"WITH {ANN} SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1",
    "reannotation_queue": f"WITH {ANN}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1) SELECT {KEEP} FROM bin WHERE id IN (SELECT id FROM d)",
    "gold_without_disagreement": f"WITH {ANN}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1) SELECT {KEEP} FROM bin WHERE id NOT IN (SELECT id FROM d)",
    "work_queue_remaining": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "distinct_count_share": f"WITH {ANN}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1) SELECT (SELECT count(*) FROM d) AS n_disagree, count(DISTINCT id) AS n_items, (SELECT count(*) FROM d) / count(DISTINCT id) AS share FROM bin",
    "value_counts_normalized": f"WITH {GOLD} SELECT split, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM gold GROUP BY split",
    "crosstab_counts": f"WITH {GOLD} SELECT label_incivility, label_intolerance, count(*) AS n FROM gold GROUP BY ALL",
    "crosstab_share": f"WITH {GOLD} SELECT label_incivility, label_intolerance, count(*) / sum(count(*)) OVER () AS share FROM gold GROUP BY label_incivility, label_intolerance",
    "hypothesis_match": hypothesis("(n11 + n00) / n AS match_rate"),
    "hypothesis_correlation": hypothesis(f"round({PHI}, 9) AS correlation"),
    "hypothesis_chi2": hypothesis("round(coalesce(n::DOUBLE * power(greatest(abs(n11::DOUBLE * n00 - n10::DOUBLE * n01) - n / 2, 0), 2) / nullif((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00), 0), 0.0), 6) AS chi2"),
    "category_conditional_rate": votes() + " SELECT category, n, k, rate FROM k",
    "category_phi": votes() + " SELECT category, n, round(phi, 9) AS phi FROM k",
    "category_wilson_ci": votes() + f" SELECT category, n, round((rate + {Z95 * Z95!r} / (2 * n)) / (1 + {Z95 * Z95!r} / n) - {Z95!r} * sqrt(rate * (1 - rate) / n + {Z95 * Z95!r} / (4 * n * n)) / (1 + {Z95 * Z95!r} / n), 9) AS low, round((rate + {Z95 * Z95!r} / (2 * n)) / (1 + {Z95 * Z95!r} / n) + {Z95!r} * sqrt(rate * (1 - rate) / n + {Z95 * Z95!r} / (4 * n * n)) / (1 + {Z95 * Z95!r} / n), 9) AS high FROM k",
    "stratified_sample_fraction": f"WITH {GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(id || '-42'), id) AS r, count(*) OVER (PARTITION BY split) AS n FROM gold) SELECT id, split FROM r WHERE r <= round(n * 0.21)",
    "label_balanced_slice": f"WITH {GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY label_hateful ORDER BY md5(id || '-42'), id) AS r, count(*) OVER (PARTITION BY label_hateful) AS n FROM gold) SELECT id, label_hateful FROM r WHERE r <= round(n * 0.5)",
    "sample_n_per_group": f"WITH {GOLD} SELECT id, split FROM gold QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5(id || '-42'), id) <= 3",
    "stratified_split": f"WITH {GOLD}, s AS ({SPLIT.format(by='', seed=42, source='gold')}) SELECT id, {PART} FROM s",
    "split_label_balance": f"WITH {GOLD}, s AS ({SPLIT.format(by='', seed=42, source='gold')}), parts AS (SELECT *, {PART} FROM s), b AS ({balance('')}) SELECT label, train, validation, test, (abs(validation - train) + abs(test - train)) / 2 AS drift FROM b",
    "best_seed": f"WITH {GOLD}, g AS (SELECT gold.*, x.seed FROM gold, (SELECT unnest(range(50))::INT AS seed) x), s AS ({APART.format(by='seed,', seed='seed', source='g')}), parts AS (SELECT *, {PART} FROM s), b AS ({balance('seed')}), m AS (SELECT seed, round(avg((abs(validation - train) + abs(test - train)) / 2), 9) AS drift FROM b GROUP BY seed) SELECT seed, drift FROM m ORDER BY drift, seed LIMIT 1",
    "logit_odds_ratios": regression([t for t in TERMS if t.startswith("incivility")]) + " " + WALD,
    "workflow_regression": regression(TERMS) + " " + WALD,
    "regression_fit": regression(TERMS) + f""" SELECT n::BIGINT AS n, true AS converged, false AS separated, false AS singular, round(l, 6) AS log_likelihood, round(n * (s * ln(s) + (1 - s) * ln(1 - s)), 6) AS null_log_likelihood,
 round(1 - l / (n * (s * ln(s) + (1 - s) * ln(1 - s))), 6) AS pseudo_r2, round({2 * (len(TERMS) + 1)} - 2 * l, 6) AS aic FROM fit""",
    "soft_label_table": f"WITH {ANN}, {soft_all()} SELECT id, hateful, {', '.join(f'round({c}, 9) AS {c}' for c in SOFT)} FROM soft",
    "workflow_evaluate_api_fine": f"WITH {GOLD}, j AS (SELECT 'incivility' AS category, label_incivility AS y, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS p FROM gold UNION ALL SELECT 'intolerance', label_intolerance, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END FROM gold), {metrics('j', 'category')} SELECT category, {METRICS} FROM m",
    "saved_evaluation": f"""WITH {PRED}, {metrics('joint_', 'category')}, k AS (SELECT category, count(*) FILTER (y = 0 AND p = 0) AS n00, count(*) FILTER (y = 0 AND p = 1) AS n01, count(*) FILTER (y = 1 AND p = 0) AS n10, count(*) FILTER (y = 1 AND p = 1) AS n11, count(*) FILTER (y = 0) AS s0, count(*) FILTER (y = 1) AS s1 FROM joint_ GROUP BY category)
 SELECT m.category, n, round(f1, 9) AS f1, round({ratio('n00', 's0')}, 9) AS c00, round({ratio('n01', 's0')}, 9) AS c01, round({ratio('n10', 's1')}, 9) AS c10, round({ratio('n11', 's1')}, 9) AS c11,
 'one' AS run_id, (SELECT round(avg(accuracy), 9) FROM m) AS mean_accuracy, (SELECT round(avg(f1), 9) FROM m) AS mean_f1, (SELECT count(*) FROM raw) AS n_rows FROM m JOIN k ON k.category = m.category""",
    "resumed_scoring": f"WITH {GOLD} SELECT id, CASE WHEN length(coalesce(text, '')) % 2 = 1 THEN 'Hateful' ELSE 'Neutral' END AS output, NULL::VARCHAR AS error FROM gold",
    "tolerant_log": f"WITH {ANN} SELECT annotator, count(*) AS n, sum(label_hateful)::BIGINT AS n_hateful FROM ann WHERE seq % 50 > 2 GROUP BY annotator UNION ALL SELECT 'lines that cannot be read', count(*), NULL FROM ann WHERE seq % 50 < 2",
    "stream_state": f"WITH {ANN} SELECT id, annotator, label_incivility, label_intolerance, label_hateful, seq FROM ded",
    "appended_batches": "SELECT n_nationkey, n_name, n_regionkey, 'region-' || n_regionkey AS batch FROM nation WHERE n_regionkey < 2",
    "ordered_rates": votes() + f", w AS (SELECT split_part(category, '_', 1) AS \"group\", {titled()} AS label, n, rate FROM k) SELECT (row_number() OVER (ORDER BY \"group\", rate DESC, label))::INT AS place, * FROM w",
    "ordered_categories": votes() + " SELECT (row_number() OVER (ORDER BY split_part(category, '_', 1), rate DESC, category))::INT AS place, split_part(category, '_', 1) AS dimension, category, rate FROM k",
    "ordered_shares": shares(),
    "ordered_work_queue": f"WITH {ANN}, {GOLD} SELECT id, (row_number() OVER (ORDER BY id))::INT AS place FROM gold WHERE id NOT IN (SELECT id FROM ann WHERE annotator = 'Annotator_2')",
    "ordered_review": f"WITH {ANN}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_hateful) > 1 OR count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1) SELECT (row_number() OVER (ORDER BY id, annotator))::INT AS place, id, annotator FROM bin WHERE id IN (SELECT id FROM d)",
    "rounded_prices": "SELECT l_returnflag, l_linestatus, sum(format('{:.2f}', l_extendedprice / l_quantity)::DECIMAL(18, 2))::DOUBLE AS unit_prices, count(*) FILTER (format('{:.2f}', l_discount / 2)::DOUBLE = 0) AS no_discount FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "batch_scorer_stub": f"WITH {GOLD} SELECT id, label_hateful, CASE WHEN length(coalesce(text, '')) % 2 = 1 THEN 'Hateful' ELSE 'Neutral' END AS output FROM gold",
    "queue_by_task": f"""WITH {ANN}, {GOLD}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1), i AS (SELECT id, 'data/' || img AS img_path, id IN (SELECT id FROM d) AS disputed FROM gold WHERE id % 3 > 0)
 SELECT 'reannotate' AS task, id, img_path FROM i WHERE disputed AND id NOT IN (SELECT id FROM ann WHERE annotator = 'Annotator_2' AND seq % 5 = 0)
 UNION ALL SELECT 'calibrate', id, img_path FROM i WHERE NOT disputed AND id NOT IN (SELECT id FROM ann WHERE annotator = 'Annotator_2' AND seq % 7 = 0)""",
    "found_items": f"WITH {GOLD} SELECT split AS value, count(*) AS n FROM gold WHERE id % 3 > 0 GROUP BY split UNION ALL SELECT (id % 2)::VARCHAR, count(*) FROM gold WHERE id % 3 > 0 GROUP BY id % 2",
    "listed_files": "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS folder, true AS is_part FROM nation",
    "report_lines": """WITH c AS (SELECT c_mktsegment AS s, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) AS r, count(*) OVER () AS m FROM customer GROUP BY c_mktsegment)
 SELECT 'latex' AS kind, 0 AS place, 'c\\_mktsegment & n & one \\\\' AS line UNION ALL SELECT 'latex', r::INT, s || ' & ' || n || ' & 1.00 \\\\' FROM c
 UNION ALL SELECT 'report', 0, 'Segments' UNION ALL SELECT 'report', 1, '========' UNION ALL SELECT 'report', (r + 1)::INT, 'c_mktsegment=' || s || '  n=' || n FROM c UNION ALL SELECT DISTINCT 'report', (m + 2)::INT, '' FROM c""",
    "run_names": "SELECT event_id, 'eval_' || strftime(ts, '%y%m%d-%H%M%S') AS name, CASE WHEN event_type LIKE 'p%' THEN 'payment' ELSE 'other' END AS kind FROM events",
    "batch_assignment": "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 32 AS INT) AS place FROM documents",
    "left_join_metadata": "SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
    "missing_metadata_count": "SELECT count(*) FILTER (d.lang IS NULL) AS missing_lang, count(*) FILTER (d.source IS NULL) AS missing_source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
    "set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_intersection": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "set_equality": "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS same",
    "union_tagged": "SELECT doc_id, lang, NULL::INT AS quality, 'documents' AS split, 0 AS priority FROM documents UNION ALL SELECT doc_id, NULL, quality, 'labels', 1 FROM labels",
    "codes_to_names": f"WITH {ANN} SELECT id, annotator, array_to_string(list_transform(string_split(label_intolerance, ','), lambda x: {value_map(INTOLERANCE)}[x::INT]), ', ') AS names FROM bin",
    "sanitize_names": "SELECT p_partkey, replace(replace(p_brand || '/' || p_type, ' ', '_'), '/', '_') AS name FROM part",
    "path_charset_strip": f"WITH {GOLD} SELECT id, ltrim(img, 'img/') AS stripped, regexp_replace(img, '^img/', '') AS without_prefix FROM gold",
    "train_messages_coarse": messages("coarse", "train"),
    "train_messages_fine": messages("fine", "train"),
    "train_messages_joint": messages("joint", "train"),
    "inference_messages": messages("joint", "inference"),
    "api_messages": messages("coarse", "api"),
    "assemble_conversations": "SELECT conv_id, count(*)::INT AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id",
    "last_assistant_reply": "SELECT c.conv_id, r.text AS reply FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1) r ON c.conv_id = r.conv_id",
    "image_fit_geometry": "WITH i AS (SELECT p_partkey AS id, (1 + p_partkey * 37 % 3000)::INT AS w, (1 + p_partkey * 91 % 2000)::INT AS h FROM part), a AS (SELECT *, w::DOUBLE / h AS q FROM i), e AS (SELECT *, 768 * q AS x, 1024 / q AS y FROM a), s AS (SELECT id, w, h, CASE WHEN w <= 1024 AND h <= 768 THEN w WHEN 1024::DOUBLE / 768 >= q THEN greatest(1, CASE WHEN abs(q - ceil(x) / 768) < abs(q - floor(x) / 768) THEN ceil(x) ELSE floor(x) END) ELSE 1024 END::INT AS new_w, CASE WHEN w <= 1024 AND h <= 768 THEN h WHEN 1024::DOUBLE / 768 >= q THEN 768 ELSE greatest(1, CASE WHEN floor(y) = 0 OR abs(q - 1024 / ceil(y)) < abs(q - 1024 / floor(y)) THEN ceil(y) ELSE floor(y) END) END::INT AS new_h FROM e) SELECT *, ((1024 - new_w) // 2)::INT AS pad_left, ((768 - new_h) // 2)::INT AS pad_top, (1024 - new_w - (1024 - new_w) // 2)::INT AS pad_right, (768 - new_h - (768 - new_h) // 2)::INT AS pad_bottom FROM s",
    "parsed_predictions": f"WITH {PRED} SELECT c.id, c.p AS coarse, i.p AS incivility, t.p AS intolerance, h.p AS hateful FROM coarse c JOIN joint_ i ON c.id = i.id AND i.category = 'incivility' JOIN joint_ t ON c.id = t.id AND t.category = 'intolerance' JOIN joint_ h ON c.id = h.id AND h.category = 'hateful'",
    "normalized_outputs": f"WITH {PRED} SELECT id, c AS output FROM low",
    "confusion_matrix_array": f"WITH {PRED}, k AS (SELECT category, x.i AS y, z.j AS p FROM (SELECT DISTINCT category FROM joint_) c, (SELECT unnest([-1, 0, 1]) AS i) x, (SELECT unnest([-1, 0, 1]) AS j) z), n AS (SELECT category, y, p, count(*) AS n FROM joint_ GROUP BY ALL), t AS (SELECT category, y, count(*) AS t FROM joint_ GROUP BY ALL) SELECT k.category, (k.y + 1)::INT AS i, (k.p + 1)::INT AS j, coalesce(n.n / t.t, 0.0) AS rate FROM k LEFT JOIN n ON k.category = n.category AND k.y = n.y AND k.p = n.p LEFT JOIN t ON k.category = t.category AND k.y = t.y",
    "csv_round_trip": f"WITH {ANN} SELECT seq, len(string_split(label_intolerance, ','))::INT AS n_codes, list_contains(string_split(label_intolerance, ','), '0') AS has_zero, label_intolerance AS codes FROM ann",
    "data_urls": f"WITH {GOLD} SELECT id, 'data:image/png;base64,' || to_base64(encode(text)) AS url, 'img' AS folder, split AS picked FROM gold",
    "calibration_review": f"WITH {ANN}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_hateful) > 1 OR count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1) SELECT id, annotator, array_to_string(list_transform(string_split(label_incivility, ','), lambda x: {value_map(INCIVILITY)}[x::INT]), ', ') AS incivility, array_to_string(list_transform(string_split(label_intolerance, ','), lambda x: {value_map(INTOLERANCE)}[x::INT]), ', ') AS intolerance FROM bin WHERE id IN (SELECT id FROM d)",
    "training_part_messages": f"WITH {GOLD}, s AS ({SPLIT.format(by='', seed=42, source='gold')}), p AS (SELECT *, {PART} FROM s), q AS (SELECT id, row_number() OVER (PARTITION BY label_hateful ORDER BY md5(id || '-3407'), id) AS r2, count(*) OVER (PARTITION BY label_hateful) AS n2 FROM p WHERE part = 'train') SELECT id, 3 AS n_turns FROM q WHERE r2 <= round(n2 * 0.5)",
    "run_grid_cross_join": "SELECT run, lora_r, learning_rate, split, n FROM (VALUES (0, 8, 0.0001::DOUBLE), (1, 16, 0.0001), (2, 8, 0.0002), (3, 16, 0.0002)) AS g(run, lora_r, learning_rate), (SELECT lang AS split, count(*) AS n FROM documents GROUP BY lang) d",
    "pairwise_kappa_codes": f"WITH {ANN}, met AS (SELECT l.label, a.annotator AS annotator_a, b.annotator AS annotator_b, CASE l.label WHEN 'label_incivility' THEN a.label_incivility ELSE a.label_intolerance END AS x, CASE l.label WHEN 'label_incivility' THEN b.label_incivility ELSE b.label_intolerance END AS z FROM bin a JOIN bin b ON a.id = b.id AND a.annotator < b.annotator, (VALUES ('label_incivility'), ('label_intolerance')) AS l(label)), s AS (SELECT label, annotator_a, annotator_b, count(*) AS n, count(*) FILTER (x = z) / count(*) AS o FROM met GROUP BY ALL), xs AS (SELECT label, annotator_a, annotator_b, x AS v, count(*) AS c FROM met GROUP BY ALL), zs AS (SELECT label, annotator_a, annotator_b, z AS v, count(*) AS c FROM met GROUP BY ALL), e AS (SELECT label, annotator_a, annotator_b, sum(xs.c::DOUBLE * zs.c) AS e FROM xs JOIN zs USING (label, annotator_a, annotator_b, v) GROUP BY ALL) SELECT label, annotator_a, annotator_b, n, o AS agreement, round((o - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 9) AS kappa FROM s JOIN e USING (label, annotator_a, annotator_b)",
    "annotator_overlap": f"WITH {ANN}, o AS (SELECT DISTINCT annotator, id FROM ann), n AS (SELECT annotator, count(*) AS n FROM o GROUP BY annotator), c AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, count(*) AS n_common FROM o a JOIN o b ON a.id = b.id AND a.annotator < b.annotator GROUP BY ALL) SELECT annotator_a, annotator_b, n_common, x.n AS n_a, y.n AS n_b, n_common = x.n AND n_common = y.n AS complete FROM c JOIN n x ON x.annotator = annotator_a JOIN n y ON y.annotator = annotator_b",
    "run_ids": "WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'hub/' || replace(p_brand, '#', '-') ELSE 'runs/' || p_brand || '/last' END AS model, p_brand FROM part) SELECT id, model, id % 2 = 0 AS published, CASE WHEN id % 2 = 0 THEN 'eval_joint_' || replace(model, '/', '_') ELSE 'eval_joint_' || p_brand END AS run_id FROM m",
    "workflow_validate": agreement() + " SELECT label, count(*) AS n_pairs, round(avg(agreement), 9) AS agreement_mean, round(stddev_pop(agreement), 9) AS agreement_std, round(avg(kappa), 9) AS kappa_mean, round(stddev_pop(kappa), 9) AS kappa_std FROM pairs GROUP BY label",
    "workflow_coverage": f"WITH {ANN} SELECT annotator, count(DISTINCT id) AS n_items, count(DISTINCT id) = (SELECT count(DISTINCT id) FROM ann) AS complete FROM ann GROUP BY annotator",
    "workflow_violations": f"WITH {ANN} SELECT 'label_incivility' AS label, count(*) FILTER (list_contains(string_split(label_incivility, ','), '0') AND contains(label_incivility, ',')) AS n_violations FROM ann UNION ALL SELECT 'label_intolerance', count(*) FILTER (list_contains(string_split(label_intolerance, ','), '0') AND contains(label_intolerance, ',')) FROM ann",
    "workflow_gold": built() + f", s AS ({APART.format(by='', seed='(SELECT seed FROM best)', source='known')}) SELECT id, text, img, split, label_hateful, label_incivility, label_intolerance, {PART} FROM s",
    "workflow_gold_balance": built() + f", s2 AS ({APART.format(by='', seed='(SELECT seed FROM best)', source='known')}), parts AS (SELECT *, {PART} FROM s2), b2 AS ({balance('')}) SELECT label, round(train, 9) AS train, round(validation, 9) AS validation, round(test, 9) AS test, round((abs(validation - train) + abs(test - train)) / 2, 9) AS drift FROM b2",
    "workflow_fine_grained": votes() + f" SELECT split_part(category, '_', 1) AS dimension, category, n, k, rate, round(phi, 9) AS phi, {wilson()} FROM k",
    "workflow_charts": votes() + f", w AS (SELECT *, {wilson(False)} FROM k) SELECT split_part(category, '_', 1) AS \"group\", {titled()} AS label, n, rate, round(rate - low, 9) AS below, round(high - rate, 9) AS above FROM w",
    "workflow_relation": hypothesis("(n11 + n00) / n AS match_rate, round(coalesce(n::DOUBLE * power(greatest(abs(n11::DOUBLE * n00 - n10::DOUBLE * n01) - n / 2, 0), 2) / nullif((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00), 0), 0.0), 6) AS chi2"),
    "workflow_descriptive": f"WITH {GOLD} SELECT 'splits' AS part, split AS value, count(*) AS n FROM gold GROUP BY split UNION ALL SELECT 'labels', label_hateful::VARCHAR, count(*) FROM gold GROUP BY label_hateful UNION ALL SELECT 'label_incivility', label_incivility::VARCHAR, count(*) FROM gold GROUP BY label_incivility",
    "workflow_evaluate_local": f"WITH {GOLD}, j AS (SELECT 'hateful' AS category, label_hateful AS y, 1 AS p FROM gold UNION ALL SELECT 'incivility', label_incivility, 0 FROM gold UNION ALL SELECT 'intolerance', label_intolerance, 0 FROM gold), {metrics('j', 'category')} SELECT category, {METRICS} FROM m",
    "workflow_evaluate_api": f"WITH {GOLD}, j AS (SELECT 'hateful' AS category, label_hateful AS y, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS p FROM gold), {metrics('j', 'category')} SELECT category, {METRICS} FROM m",
    "workflow_training_runs": f"WITH {GOLD}, s AS ({SPLIT.format(by='', seed=42, source='gold')}), p AS (SELECT *, {PART} FROM s) SELECT run, lora_r, epochs, 0.0002::DOUBLE AS rate, (SELECT count(*) FROM p WHERE part = 'train') AS n_rows FROM (VALUES (0, 8, 3), (1, 16, 2)) AS g(run, lora_r, epochs)",
    "json_lines_round_trip": f"WITH {ANN} SELECT id, annotator, label_incivility, label_intolerance, label_hateful, text, seq::VARCHAR AS time, NULL::VARCHAR AS img FROM ann",
    "published_dataset": f"WITH {GOLD} SELECT id, split, label_hateful, label_incivility, label_intolerance FROM gold WHERE split = 'train'",
    "split_items_keep_first": f"WITH {GOLD} SELECT id, CASE WHEN id % 3 > 0 THEN label_hateful ELSE 7 END AS label, CASE WHEN id % 3 > 0 THEN 'train' ELSE 'dev' END AS split FROM gold",
    "id_list_round_trip": "SELECT doc_id AS id FROM labels WHERE doc_id IS NOT NULL",
    "bias_of_runs": f"WITH {PRED}, j AS (SELECT 'one' AS run_id, * FROM joint_ UNION ALL SELECT 'two', * REPLACE (1 AS p) FROM joint_), c AS (SELECT run_id, category, {CELLS} FROM j GROUP BY run_id, category) SELECT 'joint' AS task, run_id, category, n, tp, tn, fp, fn, {ratio('fp', '(fp + tn)')} AS fpr, {ratio('fn', '(fn + tp)')} AS fnr FROM c",
    "stream_latest": f"WITH {ANN} SELECT id, annotator, label_incivility, label_intolerance, label_hateful, seq FROM ded",
    "scalar_texts": "SELECT p_partkey AS id, array_to_string(list_transform(string_split(replace(p_type, '/', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title, p_name AS trimmed, (p_partkey % 10 + p_size % 10)::INT AS sum_of_codes, CASE WHEN p_partkey % 10 = 0 OR p_size % 10 = 0 THEN 0 ELSE 1 END AS no_zero, CASE WHEN len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)) > 0 THEN array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4), chr(10)) END AS lines FROM part",
    "work_queue_of_annotator": f"WITH {ANN}, {GOLD} SELECT id FROM gold WHERE id NOT IN (SELECT id FROM ann WHERE annotator = 'Annotator_2')",
    "annotation_sample": f"WITH {GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(id || '-42'), id) AS r, count(*) OVER (PARTITION BY split) AS n FROM gold) SELECT id, split FROM r WHERE r <= round(n * 0.21)",
    "reannotation_plan": f"WITH {ANN}, d AS (SELECT id FROM bin GROUP BY id HAVING count(DISTINCT label_incivility_bin) > 1 OR count(DISTINCT label_intolerance_bin) > 1) SELECT id, 'again' AS part FROM d UNION ALL SELECT DISTINCT id, 'agreed' FROM bin WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT 0, 'calibrated elsewhere'",
    "metrics_of_runs": f"WITH {PRED}, {metrics('joint_', 'category')} SELECT run_id, category, n, accuracy, f1, f1 AS f1_read FROM m, (VALUES ('a'), ('b')) AS r(run_id)",
    "api_replies": f"WITH {GOLD} SELECT id, CASE WHEN id % 5 > 0 THEN split END AS output, CASE WHEN id % 2 = 0 THEN 'first' || chr(10) || split END AS reasoning FROM gold",
}

_FITTED = ORACLES["image_fit_geometry"]
#: The same sizes, of those images whose headers say any.
ORACLES["image_headers"] = f"SELECT p.p_partkey AS id, f.w, f.h, f.new_w, f.new_h FROM part p LEFT JOIN ({_FITTED}) f ON f.id = p.p_partkey AND p.p_partkey % 4 < 3"
