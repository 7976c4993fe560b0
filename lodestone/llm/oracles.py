"""DuckDB SQL with the same rows as the queries; the other queries are tested against brute force."""

_CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e as (
  select *, replace(replace(replace(body, '\', '\\'), '<', '\<'), '>', '\>') as eb,
    replace(replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>'), chr(10), '\' || chr(10)) as er from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn nulls first, role, eb)) as turns_sha256,
  coalesce(sum(length(body)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(body, '' order by turn nulls first, role, eb) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(er) + length(eb) + 16)::bigint as formatted_chars
from e group by conv_id
"""

#: These pages mark their main text by one article element, whose only inline tag is b and only references &quot;, &lt;, &gt; and &amp;.
_PAGES = r"""
with t as (
  select page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as "text" from pages
)
select page_id, url, "text", length("text")::bigint as n_chars from t
"""



def _lloyd(rounds: int = 10) -> str:
    """Every round as two tables: the nearest centroid of each vector, then the new centroids."""
    nearest = "select v.id, v.x, min(row(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c.k)) as at from v, c{r} c group by all"
    moved = """
    select c.k, coalesce(n.x, c.x) as x from c{r} c left join (
      select k, list((s - ((s % n) + n) % n) // n order by i) as x from (
        select a.at[2] as k, u.i, sum(a.x[u.i])::bigint as s, count(*) as n from a{r} a, (select unnest(range(1, 65)) as i) u group by all
      ) group by k
    ) n using (k)"""
    steps = ", ".join(f"a{r} as materialized ({nearest.format(r=r)}), c{r + 1} as materialized ({moved.format(r=r)})" for r in range(rounds))
    return f"""
with v as materialized (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings
  where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))
), c0 as materialized (
  select row_number() over (order by h, x) - 1 as k, x from (select sha256('3:' || vec_id) as h, x from v order by h, x limit 8)
), {steps}, a{rounds} as materialized ({nearest.format(r=rounds)})
select v.vec_id, a.at[2]::int as "cluster", a.at[1] as distance, (sum(a.at[1]) over (partition by a.at[2]))::bigint as cluster_inertia, (sum(a.at[1]) over ())::bigint as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join v using (id) join c{rounds} c on c.k = a.at[2]
"""


_AUDIT = r"""
with l as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), t as (
  select doc_id, coalesce(lang, '') as part, coalesce("text", '') as body, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') as w from documents
), d as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
    'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) over (partition by body), false)} as f
  from t left join l using (doc_id)
), m as (
  select part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: case c when 'A' then f.A when 'B' then f.B when 'C' then f.C when 'D' then f.D else f.E end) as fails,
    count(*) as n, sum(good) as good, sum(toxic) as toxic from d group by all
), x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c), o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s as (
  select filter_order, step::int as step, filter_order[step] as own, list_transform(range(1, step), lambda i: filter_order[i]) as earlier from o, range(1, 6) r(step)
), r as (
  select part, filter_order, step, n, good, toxic, list_contains(fails, own) as failing, not list_has_any(fails, earlier) as passed, len(fails) as k from m, s
)
select part, filter_order, step, coalesce(sum(n) filter (where passed and not failing), 0)::bigint as kept, coalesce(sum(n) filter (where passed and failing), 0)::bigint as removed,
  coalesce(sum(n) filter (where not passed and failing), 0)::bigint as redundant, coalesce(sum(n) filter (where failing and k = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where passed and failing), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where passed and failing), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) filter (where failing), 0)::bigint as shapley
from r group by all
"""

SQL: dict[str, str] = {"op1_chat_format": _CHAT, "op10_html_text": _PAGES, "op12_lloyd": _lloyd(), "op13_filter_audit": _AUDIT}
