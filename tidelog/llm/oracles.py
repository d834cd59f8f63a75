"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidelog.llm.fingerprint import BITS, CUT, LANES, LONG, MARKS

OP8 = r"""
with rows as (
  select doc_id, coalesce('0' || source, '1') as src,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
per as (select src, cast(sum(size) as bigint) as source_size from rows group by src),
weighed as (select *, [3, 1, 2][1 + (row_number() over (order by src) - 1) % 3] as w from per),
run as (
  select *, sum(source_size) over () as all_size, sum(w) over () as all_w,
         coalesce(sum(source_size) over o, 0) as size_before, coalesce(sum(w) over o, 0) as w_before
  from weighed
  window o as (order by source_size / w, src rows between unbounded preceding and 1 preceding)),
marked as (select *, (3 * all_size - 4 * size_before) * w > 4 * source_size * (all_w - w_before) as capped from run),
summed as (
  select *, coalesce(sum(source_size) filter (capped) over (), 0) as size_capped,
         coalesce(sum(w) filter (capped) over (), 0) as w_capped
  from marked),
aimed as (
  select src, source_size,
         coalesce(case when capped then 2 * cast(source_size as double)
              else cast((3 * all_size - 4 * size_capped) * w as double) / (2.0::double * (all_w - w_capped)) end, 0) as target
  from summed),
cut as (
  select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as fully from aimed),
summing as (
  select r.doc_id, r.size, c.source_size, c.target, c.fully,
         cast(floor(target) as bigint) - c.fully * c.source_size as rest,
         coalesce(sum(size) over (partition by r.src order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from rows r join cut c on r.src = c.src)
select doc_id, size, source_size, target,
       cast(fully * size + greatest(0, least(size, rest - before)) as bigint) as taken
from summing
"""

_UNITS = "list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x <> '')"


def _fingerprint(text: str) -> str:
    parts = _UNITS.format(parts=rf"string_split_regex({text}, '\n+')")
    runs = rf"string_split_regex({text}, '[{MARKS}\n]+')"
    clauses = _UNITS.format(parts=f"flatten(list_transform({runs}, lambda x: case when length(x) > {LONG} then string_split_regex(x, '{CUT}') else [x] end))")
    digests = f"list_transform({parts}, lambda p: sha256(p) || sha256('+' || p))"
    lane = lambda k: f"coalesce(list_sum(list_transform(d, lambda h: cast('0x' || substr(h, {8 * k + 1}, 8) as bigint))), 0) % 4294967296"
    weak = lambda k: f"coalesce(list_sum(list_transform(c, lambda h: (h >> {k}) & 1)), 0)"
    strong = " || ".join(f"lpad(lower(to_hex(cast({lane(k)} as bigint))), 8, '0')" for k in range(LANES))
    # bit 20 j + i is lane 20 j + i of the sketch
    sketch = ", ".join(f"cast({weak(k)} as bigint)" for k in range(BITS))
    return (
        f"(select struct_pack(strong := {strong}, sk := [{sketch}, cast(len(c) as bigint)]) from (select {digests} as d, "
        f"list_transform({clauses}, lambda x: cast('0x' || substr(md5(x), 1, 15) as bigint)) as c))"
    )


_HEX = "array_to_string(list_transform({f}.sk, lambda v: lpad(lower(to_hex(v)), 8, '0')), '')"
_LANES = f"list_transform({{f}}.sk[1:{BITS}], lambda v: v * 2 - {{f}}.sk[{BITS + 1}])"


def _near(a: str, b: str) -> str:
    dot = lambda x, y: f"cast(list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2])) as double)"
    cos = f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"case when {a} = {b} then 1.0::double when {dot(a, a)} = 0 or {dot(b, b)} = 0 then 0.0::double else round(greatest(0.0::double, least(1.0::double, {cos})), 6) end"


OP5 = f"""
with base as (select doc_id, coalesce(text, '') as text from documents),
pairs as (
  select doc_id, text, coalesce(lead(text) over o, first_value(text) over o) as next_text,
         cast(length(text) as bigint) as n_chars
  from base
  window o as (order by doc_id nulls first, md5(text))),
edits as (
  select doc_id, text, next_text, n_chars,
         substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) as edited
  from pairs),
sums as (select doc_id, n_chars, edited, {_fingerprint("text")} as f, {_fingerprint("edited")} as e, {_fingerprint("next_text")} as x from edits),
lanes as (select *, {_LANES.format(f="f")} as lf, {_LANES.format(f="e")} as le, {_LANES.format(f="x")} as lx from sums)
select doc_id, n_chars, sha256(edited) as edited_sha256,
       f.strong || '-' || {_HEX.format(f="f")} as fingerprint, e.strong || '-' || {_HEX.format(f="e")} as edited_fingerprint,
       {_near("lf", "le")} as near_edited, {_near("lf", "lx")} as near_next
from lanes
"""

OP3 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from words, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from words union select r.a, e.b from reach r join edges e on e.a = r.b),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id from words w left join sizes s on s.doc_id = w.doc_id join comp c on c.doc_id = w.doc_id
"""

OP7 = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from words, unnest(range(1, len(w) - 11)) as t(i)),
least_id as (select g, min(doc_id) as m from win group by g),
gone as (select distinct doc_id, p from (select win.doc_id, i from win join least_id using (g) where m < win.doc_id), unnest(range(i, i + 13)) as t(p)),
each as (select doc_id, p, w[p] as word from words, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select e.doc_id, string_agg(word, ' ' order by e.p) as text, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.p = e.p where g.p is null group by e.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""

PAYLOADS = """
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
sized as (select *, octet_length(b) as n, greatest(192, (octet_length(b) + 191) // 192 * 192) as m from raw)
select doc_id, cast(n as bigint) as n_bytes, cast(m as bigint) as payload_bytes, sha256(b || encode(repeat(' ', m - n))) as payload_sha256 from sized
"""


def _either(word: str) -> str:
    """The word in either case, for ASCII letters alone."""
    return "".join(f"[{c.upper()}{c}]" for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])

COUNTS = rf"""
select doc_id,
       cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as bigint) as n_assign,
       cast(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as bigint) as n_access,
       cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) as bigint) as n_hex
from documents
"""

SITE_RULES = r"""
with cut as (select page_id, case when strpos(url, '://') > 0 then url[strpos(url, '://') + 3:] end as rest from pages),
hosts as (select page_id, rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from cut),
parts as (select page_id, host, regexp_extract(coalesce(rest[length(host) + 1:], ''), '^[^?#]*') as path from hosts),
rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) as t(verdict, h, p)),
fits as (select page_id, h || p as rule, verdict from parts join rules on (host = h or host like '%.' || h) and starts_with(path, p)),
best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from fits group by page_id)
select page_id, host, path, rule, verdict from parts left join best using (page_id)
"""

LAYOUT = "select doc_id, true as \"right\" from documents"

ORACLES: dict[str, str] = {"op3_jaccard": OP3, "op5_fingerprints": OP5, "op7_substrings": OP7, "op8_mix_sources": OP8, "media_payloads": PAYLOADS, "secret_counts": COUNTS, "url_site_rules": SITE_RULES, "packing_layout": LAYOUT}
