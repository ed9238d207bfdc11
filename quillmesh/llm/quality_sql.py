"""The same judgement in DuckDB SQL: measures, votes, and every round of estimation as a step of its own."""

from __future__ import annotations

from quillmesh.llm.quality import START

_BLANK = r"[\x20\x09-\x0D]"
#: Votes in SQL, written apart from the column expressions they must equal.
VOTES = {
    "length": ("n_words >= 100", "false"),
    "word_length": ("word_chars / w BETWEEN 3 AND 9", "word_chars / w < 2 OR word_chars / w > 15"),
    "symbols": ("n_symbols / w < 0.02::DOUBLE", "n_symbols / w > 0.2::DOUBLE"),
    "symbol_share": ("n_symbols < 0.005::DOUBLE * word_chars", "n_symbols > 0.05::DOUBLE * word_chars"),
    "lines": ("n_dup_lines <= 0.1::DOUBLE * n_lines", "n_dup_lines > 0.5::DOUBLE * n_lines"),
    "repeats": ("n_repeat_words / w < 0.15::DOUBLE", "n_repeat_words / w > 0.4::DOUBLE"),
    "capitals": ("n_upper <= 0.1::DOUBLE * word_chars", "n_upper > 0.4::DOUBLE * word_chars"),
    "marks": ("n_marks / w < 0.1::DOUBLE", "n_marks / w > 0.5::DOUBLE"),
    "sentences": ("n_stops / w BETWEEN 0.01::DOUBLE AND 0.5::DOUBLE", "false"),
}


def _count(kinds: str) -> str:
    return f"length(t) - length(regexp_replace(t, '[{kinds}]', '', 'g'))"


def oracle(rounds: int = 12, imagined: float = 100.0) -> str:
    """SQL of ``quality.judge`` over ``documents``, with the columns of its query."""
    steps = [
        """docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents)""",
        f"""parts AS MATERIALIZED (SELECT k, [x FOR x IN string_split_regex(t, '{_BLANK}+') IF x <> ''] AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_replace(x, '{_BLANK}', '', 'g') <> ''] AS ls FROM docs)""",
        """spots AS (SELECT k, i, list_aggregate(ws[i : i + 2], 'string_agg', ' ') AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts WHERE len(ws) > 2))""",
        """twice AS (SELECT k, i FROM spots QUALIFY count(*) OVER (PARTITION BY k, win) > 1)""",
        """covered AS MATERIALIZED (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1)""",
        f"""m AS MATERIALIZED (SELECT docs.k, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars, ({_count('#*$%&|<>')})::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, {_count('A-Z')} AS n_upper, {_count('!?')} AS n_marks, {_count('.')} AS n_stops,
  greatest(len(ws), 1) AS w FROM docs JOIN parts ON parts.k = docs.k LEFT JOIN covered ON covered.k = docs.k)""",
        """based AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)""",
        "votes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT k, base_failed, '{r}' AS rule, CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v FROM based" for r, (good, bad) in VOTES.items()) + ")",
        "start AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {v} AS v, {START['good'][v]}::DOUBLE AS g0, {START['bad'][v]}::DOUBLE AS b0" for r in VOTES for v in (1, 0, -1)) + ")",
        "ratio0 AS MATERIALIZED (SELECT rule, v, CASE v WHEN 1 THEN greatest(ln(g0 / b0), 0) WHEN 0 THEN 0 ELSE least(ln(g0 / b0), 0) END AS r FROM start)",
        "prior0 AS (SELECT 0.8::DOUBLE AS p)",
    ]
    post = "SELECT k, 1 / (1 + exp(-(ln(any_value(p) / (1 - any_value(p))) + sum(r)))) AS g FROM votes JOIN ratio{0} USING (rule, v), prior{0} {1} GROUP BY k"
    for i in range(rounds):
        steps += [
            f"post{i} AS MATERIALIZED ({post.format(i, 'WHERE NOT base_failed')})",
            f"sum{i} AS MATERIALIZED (SELECT count(*) AS n, coalesce(sum(g), 0) AS good, coalesce(sum(1 - g), 0) AS bad FROM post{i})",
            f"prior{i + 1} AS MATERIALIZED (SELECT least(greatest((good + 0.8::DOUBLE * {imagined}) / (n + {imagined}), 0.05::DOUBLE), 0.95::DOUBLE) AS p FROM sum{i})",
            f"by{i} AS (SELECT rule, v, sum(g) AS good, sum(1 - g) AS bad FROM votes JOIN post{i} USING (k) GROUP BY 1, 2)",
            f"chance{i} AS (SELECT start.rule, start.v, ln(((coalesce(b.good, 0) + {imagined} * g0) / (s.good + {imagined})) / ((coalesce(b.bad, 0) + {imagined} * b0) / (s.bad + {imagined}))) AS x FROM start LEFT JOIN by{i} b ON b.rule = start.rule AND b.v = start.v, sum{i} s)",
            f"ratio{i + 1} AS MATERIALIZED (SELECT rule, v, CASE v WHEN 1 THEN greatest(x, 0) WHEN 0 THEN 0 ELSE least(x, 0) END AS r FROM chance{i})",
        ]
    steps.append(f"final AS ({post.format(rounds, '')})")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND g >= 0.5 AS kept FROM based JOIN final USING (k)"
