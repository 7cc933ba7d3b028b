"""DuckDB SQL that gives the same rows as the queries, where SQL can say it at a bearable cost on a small table."""

from __future__ import annotations

from .quality_rules import BASE, FULL, RULES
from .url_filter import RULES as URL_RULES
from .url_filter import SPAM_LABELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_HAS_WORD = "regexp_matches({}, '[^\\x20\\x09-\\x0D]')"


def quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(RULES.values()))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE {_HAS_WORD.format("x")} GROUP BY doc_id),
    k AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-3)) AS i FROM d WHERE len(w) >= 5)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i+5)) AS p FROM k SEMI JOIN (SELECT doc_id, g FROM k GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_stutters FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2) WHERE w[i] = w[i+1] GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
      CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs, coalesce(n_stutters, 0) AS n_stutters FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
    f AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
    SELECT *, (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {FULL.mask | BASE.mask}) = 0 AS kept, '{FULL.version}' AS policy FROM f"""


def quality_ablations() -> str:
    """What each rule of the full policy rejects, rejects alone, and what is kept without it."""
    bits = ", ".join(f"('{r}', {1 << i})" for i, r in enumerate(RULES) if r in FULL.rules)
    own = f"(fail_bits & {FULL.mask})"
    return f"""SELECT rule, count(*) FILTER (WHERE {own} & bit <> 0) AS n_failed, count(*) FILTER (WHERE {own} = bit) AS n_only, count(*) FILTER (WHERE {own} & ~bit = 0) AS n_kept_without
    FROM ({quality_rules()}) CROSS JOIN (VALUES {bits}) t(rule, bit) GROUP BY rule"""


def url_filter() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    labels = ", ".join(f"'{x}'" for x in SPAM_LABELS)
    return f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
    p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    b AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN (VALUES {rules}) t(rh, rp, v) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b USING (page_id)"""


def line_dedup() -> str:
    return f"""WITH l AS (SELECT doc_id, ln, line, list_distinct({_WORDS.format("line")}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL) WHERE {_HAS_WORD.format("line")}),
    u AS (SELECT line, min((doc_id, ln)) AS first, any_value(w) AS w, len(any_value(w)) AS n, row_number() OVER (ORDER BY line) AS id FROM l GROUP BY line),
    t AS (SELECT id, first, n, unnest(w) AS x FROM u),
    j AS (SELECT b.id FROM t a JOIN t b ON a.x = b.x AND a.first < b.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
    keep AS (SELECT first.element_0 AS doc_id, first.element_1 AS ln FROM (SELECT struct_pack(element_0 := first[1], element_1 := first[2]) AS first FROM u ANTI JOIN j USING (id))),
    per AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id IS NULL) AS n_removed FROM l LEFT JOIN keep k USING (doc_id, ln) GROUP BY l.doc_id),
    every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
    txt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS kept FROM every LEFT JOIN keep k USING (doc_id, ln) WHERE k.doc_id IS NOT NULL OR NOT {_HAS_WORD.format("line")} GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN txt USING (doc_id)"""


def ngram_jaccard() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3, 2))) AS i FROM d WHERE len(w) >= 1)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(r.low, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)"""


def substring_dedup() -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-48)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i+50)) AS p FROM k JOIN f USING (g) WHERE low < doc_id),
    cnt AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
    txt AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN txt USING (doc_id)"""
