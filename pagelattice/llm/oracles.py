"""DuckDB SQL for the operators that SQL can express exactly: by the definition of each result, not by the operator's method."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _windows(units: str, width: int) -> str:
    """A list with the text of every window of ``width`` elements of the list ``units``."""
    return f"list_transform(range(1, greatest(len({units}) - {width} + 2, 1)), lambda i: md5(array_to_string({units}[i : i + {width - 1}], ' ')))"


SUBSTRING_DEDUP = f"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents
), windows as (
  select r, doc_id, unnest({_windows("w", 50)}) as h, unnest(range(1, greatest(len(w) - 48, 1))) as pos from docs
), judged as (
  select r, pos, doc_id > min(doc_id) over (partition by h) as gone from windows
), words as (
  select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from docs
), marked as (
  select r, pos, word, coalesce(max(case when gone then 1 end) over (partition by r order by pos rows between 49 preceding and current row), 0) as gone
  from words left join judged using (r, pos)
), kept as (
  select r, sum(gone) as n_removed, string_agg(word, ' ' order by pos) filter (where gone = 0) as text from marked group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (r)
"""

SUFFIX_DEDUP = """
with docs as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as b from documents
), pieces as (
  select r, doc_id, len(b) // 2 as n, k, substr(b, 2000 * k + 1, 2198) as piece from (select *, unnest(range(0, (len(b) + 1999) // 2000)) as k from docs)
), places as (
  select *, unnest(range(0, least(1000, n - 1000 * k))) as o from pieces
), windows as (
  select r, doc_id, 1000 * k + o as pos, md5(substr(piece, 2 * o + 1, 200)) as h from places where 1000 * k + o + 100 <= n
), judged as (
  select r, pos, row_number() over (partition by h order by doc_id, pos) > 1 as gone from windows where doc_id is not null
), bytes as (
  select r, 1000 * k + o as pos, substr(piece, 2 * o + 1, 2) as byte from places
), marked as (
  select r, pos, byte, coalesce(max(case when gone then 1 end) over (partition by r order by pos rows between 99 preceding and current row), 0) as gone
  from bytes left join judged using (r, pos)
), edged as (
  select *, case when gone = 1 and coalesce(lag(gone) over (partition by r order by pos), 0) = 0 then 1 else 0 end as begins from marked
), kept as (
  select r, sum(gone) as n_removed, sum(begins) as n_spans, string_agg(byte, '' order by pos) filter (where gone = 0) as bytes from edged group by r
)
select doc_id, cast(len(b) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(kept.bytes, ''))) as kept_sha256
from docs left join kept using (r)
"""

_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in word) for word in ("password", "passwd", "secret", "token", "api_key"))
#: (kind, pattern for RE2, group whose length counts, least length); letters are listed in both cases, since RE2 folds beyond ASCII.
SECRET_KINDS = (
    ("assign", rf"({_EITHER})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 20),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)


def _found() -> str:
    return " union all ".join(f"select r, {k} as rule, '{kind}' as kind, text, regexp_extract_all(text, '{p}') as m, list_transform(regexp_extract_all(text, '{p}', {g}), lambda x: len(x) >= {n}) as long from docs" for k, (kind, p, g, n) in enumerate(SECRET_KINDS))


#: A match is the first place after the match before where its string stands: the expressions look at nothing around it.
SECRETS = f"""
with recursive docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), found as (
  select * from ({_found()}) where len(m) > 0
), placed as (
  select r, rule, kind, m, long, 1 as k, text as rest, 0 as passed, cast(null as bigint) as a, cast(null as bigint) as b from found
  union all
  select r, rule, kind, m, long, k + 1, substr(rest, strpos(rest, m[k]) + len(m[k])), passed + strpos(rest, m[k]) - 1 + len(m[k]), passed + strpos(rest, m[k]) - 1, passed + strpos(rest, m[k]) - 1 + len(m[k])
  from placed where k <= len(m)
), spans as (
  select r, rule, kind, a, b, kind || ':' || a || ':' || b as said from placed where a is not null and long[k - 1]
), digested as (
  select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    string_agg(said, ',' order by a, rule) filter (where rule < 3) as base, string_agg(said, ',' order by a, rule) as spans
  from spans group by r
)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join digested using (r)
"""

JACCARD = f"""
with recursive docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents
), sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as s from docs
), shingles as (
  select r, len(s) as n, unnest(s) as h from sets where doc_id is not null
), common as (
  select a.r as x, b.r as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as c
  from shingles a join shingles b on a.h = b.h and a.r < b.r and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n group by a.r, b.r
), links as (
  select x, y from common where 100 * c >= 90 * (nx + ny - c)
), edges as (
  select x, y from links union all select y, x from links
), reached as (
  select x, x as y from edges union select reached.x, edges.y from reached join edges on reached.y = edges.x
), smallest as (
  select reached.x as r, min(doc_id) as component_id from reached join sets on sets.r = reached.y group by reached.x
)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id from sets left join smallest using (r)
"""

#: Fixed value: what no word holds, after A-Z are lower case.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{PLAIN_WORD}') as w from documents
), items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all({LOWER}, '{PLAIN_WORD}') as w from benchmark
), item_windows as (
  select item_id, least(10, len(w)) as n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i : i + 9], ' '))) as h from items where len(w) > 0
), sizes as (
  select distinct n from item_windows
), windows as (
  select r, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i : i + n - 1], ' '))) as h, unnest(range(1, greatest(len(w) - n + 2, 1))) as pos from docs, sizes
), hits as (
  select r, n, pos, item_id from windows join item_windows using (n, h)
), covered as (
  select r, count(distinct word) as n_hit from (select r, unnest(range(pos, pos + n)) as word from (select distinct r, n, pos from hits)) group by r
), named as (
  select r, list_sort(list(distinct item_id)) as items from hits where item_id is not null group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join named using (r)
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op6_secrets": SECRETS,
    "op7_jaccard": JACCARD,
    "op9_decontaminate": DECONTAMINATE,
}
