"""SQL, for DuckDB, of the queries whose definition needs patterns, a vocabulary or templates.

These say what the results are, by plain means; the operators compute them otherwise. Patterns are
spelled without look-behind and possessive signs, which DuckDB's have not: what stands before a
secret is a group of its own, that its place leaves out.
"""

from __future__ import annotations

from .license_scan import MATCH, SHINGLE, TEMPLATES, shingles_of, words_of

_BLANK = r"[\x20\x09-\x0D]"
_OUTSIDE = "(^|[^A-Za-z0-9_])"
_LABEL = r"(?:[A-Z0-9]+\x20){0,4}?PRIVATE KEY(?: BLOCK)?"


def _either(words: str) -> str:
    """``words`` with letters of either case, of ASCII alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = f"{_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')}"
#: Kind, pattern and least length of the part that is measured. Groups: what stands before, the span, the part measured.
_SECRETS = [
    ("assign", rf"()((?:{_ASSIGN})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+))", 8),
    ("access", r"()((AKIA[A-Z0-9]+))", 16),
    ("hex", r"()(([0-9a-f]+))", 32),
    (
        "pem",
        rf"()((-----BEGIN {_LABEL}-----(?:(?:{_BLANK}+Proc-Type:\x20[0-9A-Z,]+{_BLANK}+DEK-Info:\x20[A-Z0-9-]+,[0-9A-Fa-f]+)?[^-]*-----END {_LABEL}-----|(?:[A-Za-z0-9+/=]|{_BLANK})*)))",
        0,
    ),
    ("github", rf"{_OUTSIDE}((gh[pousr]_[A-Za-z0-9]{{36,}}))", 0),
    ("slack", rf"{_OUTSIDE}((xox[abprs]-[A-Za-z0-9-]{{10,}}))", 0),
    ("jwt", r"(^|[^A-Za-z0-9_-])((eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))", 0),
    ("urlpass", r"()((://[A-Za-z0-9._~%-]*:[A-Za-z0-9._~%!$&*+=-]{3,}@[A-Za-z0-9.-]+))", 0),
]


def secrets() -> str:
    """Spans of every kind: matches and the gaps between them, whose lengths add up to places."""
    kinds = "\n  union all ".join(
        f"select rid, {k} as k, '{name}' as kind, {least} as least, regexp_extract_all(text, '{p}', 0) as hits, regexp_extract_all(text, '{p}', 1) as befores, regexp_extract_all(text, '{p}', 3) as parts, string_split_regex(text, '{p}') as gaps from d where regexp_matches(text, '{p}')"
        for k, (name, p, least) in enumerate(_SECRETS, 1)
    )
    return f"""
with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as ({kinds}),
s as (
  select rid, k, kind, least, unnest(range(len(hits))) as i, unnest(hits) as hit, unnest(befores) as before, unnest(parts) as part, unnest(list_slice(gaps, 1, len(hits))) as gap
  from m),
p as (select *, sum(length(gap) + length(hit)) over (partition by rid, k order by i) as stop from s),
f as (select rid, k, kind, kind || ':' || (stop - length(hit) + length(before)) || ':' || stop as span, stop - length(hit) + length(before) as start from p where length(part) >= least),
g as (
  select rid, count(*) filter (where k = 1) as n_assign, count(*) filter (where k = 2) as n_access, count(*) filter (where k = 3) as n_hex,
    string_agg(span, ',' order by start, k) filter (where k <= 3) as base, string_agg(span, ',' order by start, k) as spans
  from f group by rid)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (rid)
"""


def token_counts(ranks_path: str) -> str:
    """Greedy longest matches: the longest piece from every place of each different word, then a walk from its start."""
    return f"""
with recursive v as materialized (
  select hex(from_base64(token)) as piece from read_csv('{ranks_path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'varchar', 'rank': 'integer'}})),
pieces as materialized (
  select substr(piece, 3) as piece, true as first from v where piece like '20%' and length(piece) > 2
  union select piece, true from v where length(piece) = 2 and piece <> '20'
  union select piece, false from v where piece not like '20%'),
d as materialized (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
w as materialized (select row_number() over () as id, word, hex(encode(word)) as h from (select distinct unnest(words) as word from d)),
places as materialized (
  select id, p, substr(h, p + 1, (select max(length(piece)) from pieces)) as rest from (select id, h, unnest(range(0, length(h), 2)) as p from w)),
ends as (select id, p, size, substr(rest, 1, size) as piece from (select id, p, rest, unnest(range(2, length(rest) + 2, 2)) as size from places)),
longest as materialized (select id, p, max(size) as size from ends join pieces on ends.piece = pieces.piece and first = (p = 0) group by id, p),
walk as (select id, 0::bigint as p, 0::bigint as n from w union all select walk.id, walk.p + size, n + 1 from walk join longest on longest.id = walk.id and longest.p = walk.p),
counts as (select word, max(n) filter (where p = length(h)) as n from walk join w using (id) group by word),
t as (
  select rid, count(*) as n_words, sum(coalesce(n, 1)) as n_tokens, count(*) filter (where n is null) as n_unknown
  from (select rid, unnest(words) as word from d) join counts using (word) group by rid)
select doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_tokens, 0) as bigint) as n_tokens, cast(coalesce(n_unknown, 0) as bigint) as n_unknown
from d left join t using (rid)
"""


def licenses() -> str:
    """Exact containment in every window, without hashes; all templates have a shingle's words or more."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        words = words_of(text)
        own = shingles_of(words)
        rows += [f"({k}, {quoted(name)}, {len(words)}, {len(own)}, {quoted(s)})" for s in own]
    return f"""
with t(template, license, words, own, shingle) as (values {", ".join(rows)}),
d as materialized (
  select row_number() over () as rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
s as (
  select rid, p, array_to_string(list_slice(words, p, p + {SHINGLE - 1}), ' ') as shingle
  from (select rid, words, unnest(range(1, len(words) - {SHINGLE - 2})) as p from d where len(words) >= {SHINGLE})),
met as (
  select rid, template, license, words, own, shingle,
    unnest(range(greatest(0, cast(ceil((p + {SHINGLE - 1} - 2 * words) / words) as bigint)), (p - 1) // words + 1)) as place
  from s join t using (shingle)),
held as (
  select rid, words, place, template, license, list(distinct shingle) as held, count(distinct shingle) / own as containment
  from met group by rid, words, place, template, license, own having count(distinct shingle) / own >= {MATCH}),
kept as (
  select * from held m where not exists (
    select 1 from held o where o.rid = m.rid and o.words = m.words and o.place = m.place and o.containment > m.containment and list_has_all(o.held, m.held))),
g as (select rid, count(distinct license) as n, string_agg(distinct license, ',' order by license) as licenses, max(containment) as containment from kept group by rid)
select doc_id, cast(coalesce(n, 0) as bigint) as n_licenses, coalesce(licenses, '') as licenses, coalesce(containment, 0.0::double) as containment
from d left join g using (rid)
"""
