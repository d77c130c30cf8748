"""DuckDB SQL of the text queries that SQL can express."""

from tidemark.llm.hilbert import BITS, DIMENSIONS, SHARDS, curve_table
from tidemark.llm.urls import DEPTH, LIMIT, RULES, SHARE, STRENGTH, Z

WORD3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
with t as (select conv_id, turn, role, text, coalesce(cast(floor(turn / 512) as bigint), -1) as part from conversations),
who as (select distinct conv_id, role as speaker from t where role is not null and role <> 'system'),
b as (select t.*, who.speaker, coalesce(t.role = who.speaker, false) as own,
        case when t.role = who.speaker then '<|assistant|>' || chr(10) when t.role = 'system' then '<|system|>' || chr(10)
             else '<|user name=' || coalesce(t.role, 'unknown') || '|>' || chr(10) end as head,
        coalesce(t.text, '') || '<|end|>' || chr(10) as body
      from t join who on t.conv_id is not distinct from who.conv_id)
select conv_id, speaker, part, count(*) as n_turns,
  string_agg(head || body, '' order by turn nulls first, role nulls first, text nulls first) as text,
  string_agg(case when own then length(head) || ':' || length(body) else (length(head) + length(body)) || ':0' end, ','
             order by turn nulls first, role nulls first, text nulls first) as mask
from b group by all
"""

OP3 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{WORD3}') as w from documents),
i as (select item_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{WORD3}') as w from benchmark),
iw as (select distinct item_id, w[s + 1:s + 10] as win from (select item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) as s from i where len(w) > 0)),
sizes as (select distinct len(win) as m from iw),
dw as (select r, m, s, w[s + 1:s + m] as win from (select r, w, m, unnest(range(len(w) - m + 1)) as s from d, sizes where len(w) >= m)),
h as (select r, s, m, item_id from dw join iw using (win)),
n_hit as (select r, count(*) as n from (select distinct r, unnest(range(s, s + m)) as p from h) group by r),
its as (select r, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit.n, 0) as n_hit, coalesce(its.n, 0) as n_items,
  sha256(coalesce(its.ids, '')) as items_sha256, coalesce(n_hit.n, 0) > 0 as contaminated
from d left join n_hit using (r) left join its using (r)
"""

OP6 = r"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select r, doc_id, s, array_to_string(w[s + 1:s + 13], ' ') as x from (select r, doc_id, w, unnest(range(len(w) - 12)) as s from d where len(w) >= 13)),
least as (select x, min(doc_id) as o from win group by x),
gone as (select distinct r, unnest(range(s, s + 13)) as p from win join least using (x) where o < win.doc_id),
kept as (select r, string_agg(word, ' ' order by p) as text, count(*) as n from (select r, unnest(w) as word, unnest(range(len(w))) as p from d) anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r)
"""


def rule_case(value) -> str:
    out = "case "
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        out += f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{value(verdict, rule)}' "
    return out + "end"


def op8() -> str:
    sql = f"""
with recursive u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hp as (select page_id, {LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
sg as (select *, {rule_case(lambda v, r: r)} as rule, {rule_case(lambda v, r: v)} as ruled, list_filter(string_split(path, '/'), lambda x: x <> '') as s from hp),
split as (select page_id, host, path, rule, ruled, list_concat(list_transform(s[1:{DEPTH}], lambda x: regexp_replace(x, '[0-9]+', '{{n}}', 'g')), case when len(s) > {DEPTH} then ['**'] else [] end) as g from sg),
t0 as (select host, g, count(*) as n, count(ruled) as labelled, count(*) filter (ruled = 'block') as blocked, '' as parent, '' as template from split group by host, g)"""
    for k in range(DEPTH + 1):
        sql += f""",
z{k} as (select host, template, g[{k + 1}] as seg, sum(n) as size from t{k} where g[{k + 1}] is not null group by all),
r{k} as (select host, template, seg, size < {SHARE} * sum(size) over (partition by host, template) as rare from z{k}),
t{k + 1} as (select t.host, t.g, t.n, t.labelled, t.blocked, case when g[{k + 1}] is null then t.parent else t.template end as parent,
   case when g[{k + 1}] is null then t.template else t.template || '/' || case when g[{k + 1}] <> '**' and r.rare then '*' else g[{k + 1}] end end as template
   from t{k} t left join r{k} r on t.host = r.host and t.template = r.template and g[{k + 1}] = r.seg)"""
    return sql + f""",
leaf as (select host, parent, template, sum(labelled) as labelled, sum(blocked) as blocked, (sum(blocked) + 0.5::double) / (sum(labelled) + 1.0::double) as purity from t{DEPTH + 1} group by all),
ranked as (select *, row_number() over (partition by host, parent order by purity, template) as r from leaf where labelled > 0),
chain as (select host, parent, r, 1 as branch, labelled as l, blocked as b from ranked where r = 1 union all
 select q.host, q.parent, q.r, case when q.same then q.branch else q.branch + 1 end, case when q.same then q.l else 0 end + q.labelled, case when q.same then q.b else 0 end + q.blocked from (
  select c.*, n.r, n.labelled, n.blocked, abs((b + 0.5::double) / (l + 1) - (blocked + 0.5::double) / (labelled + 1)) <=
    {Z}::double * sqrt((b + blocked + 1::double) / (l + labelled + 2) * (1 - (b + blocked + 1::double) / (l + labelled + 2)) * (1::double / (l + 1) + 1::double / (labelled + 1))) as same
  from (select host, parent, r as prev, branch, l, b from chain) c join ranked n on n.host = c.host and n.parent = c.parent and n.r = c.prev + 1) q),
merged as (select k.host, k.parent, k.template, c.branch from ranked k join chain c on c.host = k.host and c.parent = k.parent and c.r = k.r),
b as (select host, parent, branch, sum(labelled) as bl, sum(blocked) as bb from merged join leaf using (host, parent, template) group by all),
up as (select host, parent, sum(labelled) as pl, sum(blocked) as pb from leaf group by all),
hs as (select host, sum(labelled) as hl, sum(blocked) as hb from leaf group by host),
prior as (select (sum(hb) + 0.5::double) / (sum(hl) + 1.0::double) as prior from hs),
share as (select host, (hb + {STRENGTH}::double * prior) / (hl + {STRENGTH}::double) as share from hs, prior),
judged as (select leaf.host, leaf.parent, leaf.template, (coalesce(bb, pb) + {STRENGTH}::double * share) / (coalesce(bl, pl) + {STRENGTH}::double) > {LIMIT} as rejected
  from leaf left join merged using (host, parent, template) left join b using (host, parent, branch) join up using (host, parent) join share using (host))
select page_id, s.host, path, rule, coalesce(ruled, case when rejected then 'block' else 'allow' end) as verdict, t.template
from split s join t{DEPTH + 1} t on s.host = t.host and s.g = t.g join judged j on j.host = t.host and j.parent = t.parent and j.template = t.template
"""


#: CTE `crc` with the table of CRC-32, and the checksum of a text expression by it.
CRC_TABLE = "crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc)"


def crc32(text: str) -> str:
    digits = f"hex({text})"
    octets = f"list_transform(range(length({digits}) // 2), lambda i: cast('0x' || substr({digits}, 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


def op13() -> str:
    names = ["size", *DIMENSIONS]
    table, n = curve_table(len(names)), len(names)
    corners = ", ".join(" + ".join(f"((l_{d} >> {i} & 1) << {j})" for j, d in enumerate(names)) for i in reversed(range(BITS)))
    sql = f"""
with {CRC_TABLE},
c as (select doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 8 as size, {crc32("coalesce(text, '')")} as text_crc32 from documents, crc),
ends as (select {", ".join(f"min(hex({d})) filter ({d} <> '') as a_{d}, max(hex({d})) filter ({d} <> '') as b_{d}" for d in DIMENSIONS)} from c),
heads as (select {", ".join(f"coalesce(len(list_filter(range(1, length(a_{d}) + 1), lambda i: left(a_{d}, i) = left(b_{d}, i))), 0) as h_{d}" for d in DIMENSIONS)} from ends),
b as (select c.*, (length(bin(size)) - 1) * 16 + (((size << 4) >> (length(bin(size)) - 1)) & 15) as b_size, {", ".join(f"substr(hex(coalesce({d}, '')), h_{d} + 1, 4) as b_{d}" for d in DIMENSIONS)} from c, heads)"""
    for d in names:
        sql += f""",
n_{d} as (select b_{d}, count(*) as n from b group by 1),
v_{d} as (select b_{d}, cast(floor(coalesce(sum(n) over (order by b_{d} rows between unbounded preceding and 1 preceding), 0) * {1 << BITS} / sum(n) over ()) as bigint) as l_{d} from n_{d})"""
    return sql + f""",
l as (select b.*, {", ".join(f"l_{d}" for d in names)} from b {" ".join(f"join v_{d} using (b_{d})" for d in names)}),
t as (select {table} as t),
h as (select l.*, list_reduce([0, {corners}], lambda a, x: ((((a >> 5) << {n}) + (t[(a & 31) * {1 << n} + x + 1] & {(1 << n) - 1})) << 5) + (t[(a & 31) * {1 << n} + x + 1] >> {n})) >> 5 as curve from l, t),
k as (select h.*, {crc32("concat_ws('/', cast(doc_id as varchar), cast(text_crc32 as varchar))")} as k from h, crc),
p as (select *, count(*) over () as n, row_number() over (order by curve, k, doc_id nulls first, text_crc32, size, {", ".join(f"{d} nulls first" for d in DIMENSIONS)}) - 1 as pos from k),
s as (select *, pos * {SHARDS} // n as shard from p)
select doc_id, cast(size as bigint) as size, text_crc32, 'rows' as law, cast(shard as integer) as shard, cast(pos - ceil(shard * n / {SHARDS}) as bigint) as slot, cast(null as integer) as grown_shard, curve from s
"""


OP11 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
least as (select text, min(doc_id) as o from d group by text),
lab as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
        100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(o < d.doc_id, false)] as f
      from d join least using (text) left join lab on lab.doc_id = d.doc_id),
c as (select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
g as (select c.*, filter_order, step, f[ascii(filter_order[step]) - 64] as own, list_contains(list_transform(range(1, step), lambda i: f[ascii(filter_order[i]) - 64]), true) as earlier,
        len(list_filter(f, lambda x: x)) as fails from c, s),
a as (select part, filter_order, step, filter_order[step] as letter, coalesce(sum(n) filter (not own and not earlier), 0) as kept, coalesce(sum(n) filter (own and not earlier), 0) as removed,
        coalesce(sum(n) filter (own and earlier), 0) as redundant, coalesce(sum(n) filter (own and fails = 1), 0) as unique_fails,
        coalesce(sum(good) filter (own and not earlier), 0) as good_lost, coalesce(sum(toxic) filter (own and not earlier), 0) as toxic_lost from g group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley from a
"""


OP12 = f"""
with {CRC_TABLE},
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
c as (select distinct conv_id, {crc32("cast(conv_id as varchar)")} % 4 as h from t, crc),
r as (select c.conv_id, i as o, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and i <= h union all select c.conv_id, 4 + i, role, text from c join t using (conv_id) where i > h),
q as (select conv_id, role, text, row_number() over (partition by conv_id order by o) as d from r),
s as (select conv_id, d, text, string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' order by d) over (partition by conv_id order by d rows unbounded preceding) as k from q),
m as (select conv_id, d, text, sha256(k) as k from s union all select conv_id, 0, '', '' from c),
p as (select m.*, coalesce(lag(k) over w, '') as pk, d = max(d) over (partition by conv_id) as last from m window w as (partition by conv_id order by d)),
n as (select d, k, min(pk) as pk, min(conv_id) as conv_id, count(*) as n, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last) as ends,
        any_value(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) as w from p group by d, k),
kids as (select d - 1 as d, pk as k, count(*) as kids from n where d > 0 group by all),
f as (select n.*, coalesce(kids, 0) as kids from n left join kids using (d, k)),
up as (select distinct x.d, x.k, y.d as yd, y.k as yk from p x join p y on x.conv_id = y.conv_id and y.d >= x.d),
below as (select up.d, up.k, sum((f.n - 1) * f.w) as saved, count(*) filter (f.kids = 0) as leaves from up join f on f.d = up.yd and f.k = up.yk group by all)
select f.conv_id, f.d as depth, case when f.d > 0 then a.conv_id end as parent_conv_id, f.n as n_convs, f.kids as n_children, b.leaves as n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
from f join below b using (d, k) left join f a on a.d = f.d - 1 and a.k = f.pk
"""


ORACLES = {"op2_perspectives": OP2, "op3_prefix_decontamination": OP3, "op6_substring_dedup": OP6, "op8_url_templates": op8(),
           "op11_filter_audit": OP11, "op12_prefix_trie": OP12, "op13_hilbert_shards": op13()}
