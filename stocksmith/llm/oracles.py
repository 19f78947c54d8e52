"""DuckDB SQL for the corpus queries that SQL can state."""

from __future__ import annotations

from . import quality_mcd as Q
from .url_digest import LOWER, UPPER

BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


# ------------------------------------------------------------------ operator 1
def _mean_and_factor(name: str, of: str, keys: str, times: float) -> str:
    """CTEs: mean m0.. and lower Cholesky factor l00.. of the covariance, from the sums in ``of``."""
    n = range(Q.DIMS)
    out = f"{name}_m as (select *, " + ", ".join(f"s{i}::double / n::double / 1024 as m{i}" for i in n) + f" from {of}),\n"
    cov = [f"{times!r} * (s{i}{j}::double / n::double / 1024 / 1024 - m{i} * m{j}) + {Q.LEAST_SPREAD[i] ** 2 if i == j else 0.0!r}::double as c{i}{j}" for i, j in Q.PAIRS]
    out += f"{name}_0 as (select {keys}, " + ", ".join([*(f"m{i}" for i in n), *cov]) + f" from {name}_m),\n"
    for k, (i, j) in enumerate(Q.PAIRS):
        left = f"c{i}{j}" + "".join(f" - l{i}{h} * l{j}{h}" for h in range(j))
        out += f"{name}_{k + 1} as (select *, {f'sqrt({left})' if i == j else f'({left}) / l{j}{j}'} as l{i}{j} from {name}_{k}),\n"
    return out + f"{name} as (select {keys}, " + ", ".join([*(f"m{i}" for i in n), *(f"l{i}{j}" for i, j in Q.PAIRS)]) + f" from {name}_{len(Q.PAIRS)}),\n"


def _distances(name: str, rows: str, to: str, join: str = "join") -> str:
    """CTE: the squared Mahalanobis distance of each row of ``rows`` to its group's estimate in ``to``."""
    at, out = f"(select r.*, e.* exclude (grp) from {rows} r {join} {to} e on r.grp = e.grp)", ""
    for i in range(Q.DIMS):
        left = f"x{i} / 1024::double - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
        at = f"(select *, ({left}) / l{i}{i} as y{i} from {at})"
    d2 = " + ".join(f"y{i} * y{i}" for i in range(Q.DIMS))
    return out + f"{name} as (select *, {d2} as d2 from {at}),\n"


SUMS = "count(*) as n, " + ", ".join([*(f"sum(x{i}) as s{i}" for i in range(Q.DIMS)), *(f"sum(x{i} * x{j}) as s{i}{j}" for i, j in Q.PAIRS)])


def quality_sql() -> str:
    n = range(Q.DIMS)
    sql = f"""
with recursive w as materialized (
  select doc_id, lang, source, coalesce(text, '') as text, {WORDS} as w from documents),
grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from w)),
often as (select doc_id, g from grams group by all having count(*) > 1),
again as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from grams join often using (doc_id, g)) group by doc_id),
lines as (select doc_id, count(*) as n, count(distinct line) as d from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
          where length(translate(line, {BLANKS}, '')) > 0 group by doc_id),
base as materialized (
  select doc_id, coalesce('=' || lang, 'null') as lang, coalesce('=' || source, 'null') as source, len(w)::bigint as n_words,
         length(translate(text, {BLANKS}, ''))::bigint as word_chars,
         (length(text) - length(translate(text, '{Q.SYMBOLS}', '')))::bigint as n_symbols,
         coalesce(l.n - l.d, 0)::bigint as n_dup_lines, coalesce(l.n, 0) as n_lines, coalesce(a.n, 0)::bigint as n_repeat_words
  from w left join lines l using (doc_id) left join again a using (doc_id)),
x as materialized (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         floor(ln(greatest(word_chars, 1)::double / greatest(n_words, 1)) * 1024 + 0.5::double)::bigint as x0,
         floor(ln(1 + 100::double * n_symbols / greatest(n_words, 1)) * 1024 + 0.5::double)::bigint as x1,
         floor(ln(1 + 100::double * n_dup_lines / greatest(n_lines, 1)) * 1024 + 0.5::double)::bigint as x2,
         floor(ln(1 + 100::double * n_repeat_words / greatest(n_words, 1)) * 1024 + 0.5::double)::bigint as x3
  from base),
sizes as (select lang, source, count(*) as n from x where not base_failed group by all),
pools as (select *, sum(case when n < {Q.MIN_ROWS} then n end) over (partition by lang) as pool from sizes),
groups as materialized (
  select lang, source, n, case when n >= {Q.MIN_ROWS} then lang || chr(1) || source when pool >= {Q.MIN_ROWS} then lang else '*' end as grp from pools),
own as materialized (select grp, x0, x1, x2, x3 from x join groups using (lang, source) where not base_failed),
r as materialized (
  select * from own where grp <> '*' or (select count(*) from own where grp = '*') >= {Q.MIN_ROWS}
  union all select '*', x0, x1, x2, x3 from own where (select count(*) from own where grp = '*') between 1 and {Q.MIN_ROWS} - 1),
med as (select grp, {", ".join(f"quantile_cont(x{i}, 0.5) as m{i}" for i in n)} from r group by grp),
mad as (select grp, {", ".join(f"quantile_cont(abs(x{i} - m{i}), 0.5) as d{i}" for i in n)} from r join med using (grp) group by grp),
robust as (select grp, 0 as start, {", ".join(f"m{i} / 1024::double as m{i}" for i in n)}, {", ".join(
    f"sqrt((1.4826::double * d{i} / 1024) * (1.4826::double * d{i} / 1024) + {Q.LEAST_SPREAD[i] ** 2!r}::double) as l{i}{j}" if i == j else f"0::double as l{i}{j}" for i, j in Q.PAIRS)}
  from med join mad using (grp)),
all_rows as (select grp, 1 as start, {SUMS} from r group by grp),
"""
    sql += _mean_and_factor("plain", "all_rows", "grp, start", 1.0)
    every = ", ".join([*(f"m{i}" for i in n), *(f"l{i}{j}" for i, j in Q.PAIRS)])
    step = _distances("near", "r", "(select * from steps where falls)")
    step += f"""hist as (select grp, start, k, det as was, floor(least(sqrt(d2), {Q.FAR}::double) * {Q.BUCKETS}) as bucket, {SUMS} from near group by all),
ranked as (select *, coalesce(sum(n) over (partition by grp, start order by bucket rows between unbounded preceding and 1 preceding), 0) as before,
  sum(n) over (partition by grp, start) as total from hist),
core as (select grp, start, k, was, {", ".join(f"sum({c}) as {c}" for c in Q._SUM_NAMES)} from ranked where before < ceil({Q.CORE} * total) group by all),
"""
    step += _mean_and_factor("est", "core", "grp, start, k, was", Q.consistency(Q.CORE)).rstrip(",\n")
    sql += f"""starts as materialized (select * from robust union all by name select * from plain),
steps as (
  select grp, start, 0 as k, 'inf'::double as det, true as falls, {every} from starts
  union all
  (with {step}
  select grp, start, k + 1, l00 * l11 * l22 * l33, l00 * l11 * l22 * l33 < was, {every} from est)),
best as (select grp, {every} from (select *, row_number() over (partition by grp order by det, start, k) as nr from steps) where nr = 1),
"""
    sql += _distances("closest", "r", "best")
    sql += f"weights as (select grp, {SUMS} from closest where d2 <= {Q.chi2_quantile(0.975)!r}::double group by grp),\n"
    sql += _mean_and_factor("final", "weights", "grp", Q.consistency(0.975))
    sql += "placed as (select x.*, g.grp from x left join groups g on x.lang = g.lang and x.source = g.source),\n"
    sql += _distances("judged", "placed", "final", "left join")
    return sql.rstrip(",\n") + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(d2, 0) <= {Q.chi2_quantile(1 - Q.TAIL)!r}::double as kept
from judged"""


# ------------------------------------------------------------------ operator 3
NEAR_DUPLICATES = r"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '""" + UPPER + "', '" + LOWER + r"""'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
  select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from w where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
links as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by all) p
  join sizes m on m.doc_id = a join sizes n on n.doc_id = b where 100 * shared >= 80 * (m.n + n.n - shared)),
reach(doc_id, other) as (
  select doc_id, doc_id from w union select r.doc_id, l.b from reach r join links l on r.other = l.a)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join sizes s using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)"""

# ------------------------------------------------------------------ operator 4
URL_RULES_SQL = rf"""
with rules(host, path, verdict) as (values {{rules}}),
parts as (
  select row_number() over () as row, page_id,
         translate(regexp_extract(coalesce(url, ''), '^(.|\n)*?://([^/?#]*)', 2), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '^(.|\n)*?://[^/?#]*([^?#]*)', 2) as path
  from pages),
fits as (
  select p.row, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.row)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f using (row)"""

# ------------------------------------------------------------------ operator 5
TOP_K = """
with v as (
  select vec_id, [floor(64 * x::double)::bigint for x in embedding] as e from embeddings
  where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select * from (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
where rank <= 20"""


# ------------------------------------------------------------------ operators 6 and 7
def _repeats(units: str, count: str, window: str, unit: str) -> str:
    """CTEs: u (a document's units) and gone (which of its units go); window(i) and unit(p) are given as SQL."""
    return f"""
with u as materialized (select doc_id, u, {count} as n from (select doc_id, {units} as u from documents)),
s as (select doc_id, i, {window} as t from (select doc_id, u, unnest(range(1, greatest(n - 48, 1))) as i from u)),
f as (select t, min(doc_id) as first from s group by t having count(*) > 1),
h as (select s.doc_id, s.i from s join f using (t) where f.first < s.doc_id),
edges as (select doc_id, p, sum(e) as e from (select doc_id, i as p, 1 as e from h union all select doc_id, i + 50, -1 from h) group by all),
places as (select doc_id, p, {unit} as unit from (select doc_id, u, unnest(range(1, n + 1)) as p from u)),
gone as materialized (
  select l.doc_id, l.p, l.unit, coalesce(sum(e.e) over (partition by l.doc_id order by l.p), 0) > 0 as gone from places l left join edges e using (doc_id, p))"""


WORD_REPEATS = _repeats(WORDS, "len(u)", "array_to_string(u[i:i + 49], ' ')", "u[p]") + """,
k as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(unit, ' ' order by p) filter (where not gone) as kept from gone group by doc_id)
select u.doc_id, u.n::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from u left join k using (doc_id)"""

# a byte is two hexadecimal digits
BYTE_REPEATS = _repeats("hex(encode(coalesce(text, '')))", "length(u) // 2", "substr(u, 2 * i - 1, 100)", "substr(u, 2 * p - 1, 2)") + """,
begun as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as starts from gone),
k as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where starts) as n_spans,
             string_agg(unit, '' order by p) filter (where not gone) as kept from begun group by doc_id)
select u.doc_id, u.n::bigint as n_bytes, coalesce(k.n_removed, 0)::bigint as n_removed, coalesce(k.n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(k.kept, ''))) as kept_sha256
from u left join k using (doc_id)"""
