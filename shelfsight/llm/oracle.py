"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from shelfsight.llm import queries, quality

# The word classes of the contracts, and the letters lowered.
_WORD = r"'[^\x20\x09-\x0D]+'"
_BENCH_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def _positions(words: str, key: str = "doc_id") -> str:
    """One row per word of the lists ``w`` of a relation: its place and the
    length of the list."""
    return f"SELECT {key}, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM {words}"


def _run(k: int) -> str:
    """The word and the up to ``k - 1`` words after it, joined by spaces."""
    return f"concat_ws(' ', x, {', '.join(f'lead(x, {j}) OVER o' for j in range(1, k))})"


def _broken(rule: quality.Rule) -> str:
    tests = []
    if rule.low is not None:
        tests.append(f"1000 * {rule.numerator} < {rule.low} * {rule.denominator}")
    if rule.high is not None:
        tests.append(f"1000 * {rule.numerator} > {rule.high} * {rule.denominator}")
    return f"CASE WHEN n_words >= {rule.min_words} AND ({' OR '.join(tests)}) THEN '{rule.name}' END"


OP1 = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
place AS ({_positions("words")}),
run AS (SELECT doc_id, n, i, {_run(5)} AS s FROM place WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingle AS (SELECT DISTINCT doc_id, s FROM run WHERE i <= greatest(n - 4, 1)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b
           ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM shared JOIN size a ON a.doc_id = u JOIN size b ON b.doc_id = v
         WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN link ON b = u),
first AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN first ON a = doc_id LEFT JOIN size USING (doc_id)
"""

OP2 = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BENCH_WORD}) AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_BENCH_WORD}) AS w FROM benchmark),
item_place AS ({_positions("items", "item")}),
item_run AS (SELECT item, n, i, x, {_run(13)} AS s FROM item_place WINDOW o AS (PARTITION BY item ORDER BY i)),
phrase AS (SELECT DISTINCT item, least(n, 13) AS k, x AS head, s FROM item_run WHERE i <= greatest(n - 12, 1)),
place AS ({_positions("words")}),
run AS (SELECT doc_id, n, i, x, {_run(13)} AS s FROM place WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
found AS (SELECT doc_id, i, k, item FROM run JOIN phrase USING (s) WHERE k = 13 AND i <= n - 12
          UNION SELECT doc_id, i, k, item FROM run JOIN phrase p ON x = head
          WHERE k < 13 AND starts_with(run.s || ' ', p.s || ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4 = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
place AS ({_positions("words")}),
run AS (SELECT doc_id, n, i, {_run(5)} AS s FROM place WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM run WHERE i <= n - 4 QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
again AS (SELECT doc_id, count(DISTINCT pos) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id),
metric AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP}))) AS n_stop_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines
  FROM words LEFT JOIN again USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         concat_ws(',', {", ".join(map(_broken, quality.RULES))}) AS broken_rules
  FROM metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM judged
"""

OP6 = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
place AS ({_positions("words")}),
run AS (SELECT doc_id, n, i, x, md5({_run(50)}) AS s FROM place WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
late AS (SELECT doc_id, i, x, i <= n - 49 AND min(doc_id) OVER (PARTITION BY s, i <= n - 49) < doc_id AS starts FROM run),
judged AS (SELECT doc_id, i, x, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM late),
text AS (SELECT doc_id, count(*) AS n, count_if(gone) AS g, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept
         FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN text USING (doc_id)
"""


def _weight(depth: int) -> str:
    cases = " ".join(f"WHEN '{value}' THEN {w}" for value, w in queries.MIX_WEIGHTS[depth].items())
    return f"CASE l{depth} {cases} ELSE 1 END"


def _family(depth: int) -> str:
    """Budgets of the nodes of one level: a child whose share would exceed
    what it can give is full, the others share the rest by weight."""
    names = ", ".join(f"l{i}" for i in range(depth + 1))
    family = "".join(f"l{i}, " for i in range(depth)) + "1"
    above = f"JOIN given{depth - 1} USING ({', '.join(f'l{i}' for i in range(depth))})" if depth else ""
    budget = "any_value(amount)" if depth else f"(SELECT least(sum(tokens) // 2, sum(tokens) * {queries.MIX_EPOCHS}) FROM leaf)"
    return f"""
child{depth} AS (SELECT {names}, sum(tokens) * {queries.MIX_EPOCHS} AS cap, {_weight(depth)} AS weight, {budget} AS budget
       FROM leaf {above} GROUP BY {names}),
order{depth} AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS below,
       sum(weight) OVER (PARTITION BY {family}) - coalesce(sum(weight) OVER before, 0) AS rest FROM child{depth}
       WINDOW before AS (PARTITION BY {family} ORDER BY cap / weight, l{depth} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full{depth} AS (SELECT *, cap * rest <= weight * (budget - below) AS is_full FROM order{depth}),
given{depth} AS (SELECT {names}, CASE WHEN is_full THEN cap ELSE
       (budget - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {family}), 0)) * weight
       // sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {family}) END AS amount FROM full{depth}),"""


OP10 = f"""
WITH doc AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS n_tokens,
         {list(queries.DOMAINS)}[1 + TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT)
                                     % {len(queries.DOMAINS)}] AS domain
  FROM documents),
named AS (SELECT *, coalesce(domain, '<null>') AS l0, coalesce(lang, '<null>') AS l1, coalesce(source, '<null>') AS l2 FROM doc),
leaf AS (SELECT l0, l1, l2, sum(n_tokens) AS tokens FROM named GROUP BY ALL),
{"".join(map(_family, range(3)))}
plan AS (SELECT l0, l1, l2, CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END AS epochs,
                CASE WHEN tokens > 0 THEN amount % tokens ELSE 0 END AS rest
         FROM leaf JOIN given2 USING (l0, l1, l2)),
prefix AS (SELECT named.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY
                  md5(concat_ws(':', '{queries.MIX_SEED}', epochs::BIGINT::VARCHAR, doc_id::VARCHAR))) AS upto
           FROM named JOIN plan USING (l0, l1, l2))
SELECT doc_id, domain, lang, source, n_tokens,
       unnest(range(0, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT))::INT AS mix_epoch
FROM prefix
"""

SQL: dict[str, str] = {"op1_near_duplicates": OP1, "op2_decontaminate": OP2, "op4_quality": OP4, "op6_substrings": OP6,
                       "op10_mix": OP10}
