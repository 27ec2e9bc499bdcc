"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rillmill.llm.license_scan import SLACK, TEMPLATES
from rillmill.llm.source_mixing import PRODUCTION, Recipe


def _case(column: str, table: dict, default) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else repr(float(v))
    return f"case {column} " + " ".join(f"when '{k}' then {quote(v)}" for k, v in table.items()) + f" else {quote(default)} end" if table else quote(default)


def _share(source: str, parent: str, name: str) -> str:
    """Children with x, their part of the parent's budget b: min(cap, level * w) with the greatest level."""
    return f"""
select *, least(cap, w * max(level) over (partition by {parent})) as x
from (select *, (b - coalesce(sum(cap) over (partition by {parent} order by cap / w, {name} rows between unbounded preceding and 1 preceding), 0))
              / sum(w) over (partition by {parent} order by cap / w, {name} rows between current row and unbounded following) as level
      from ({source}))"""


def mix_sql(r: Recipe = PRODUCTION, table: str = "documents") -> str:
    return f"""
with n as (select doc_id, {_case("coalesce(source, '')", r.domain_of, r.other_domain)} as domain, coalesce(lang, '') as lang,
                  coalesce(source, '') as source, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as n
           from {table}),
     leaf as (select domain, lang, source, cast(sum(n) as bigint) as tokens, cast(sum(n) as double) * {r.max_epochs} as cap from n group by all having sum(n) > 0),
     root as (select floor(sum(tokens) * cast({r.budget_share} as double)) as b from leaf),
     d as ({_share(f"select domain, sum(cap) as cap, any_value({_case('domain', r.domains, r.other)}) as w, any_value(root.b) as b, 0 as r from leaf, root group by domain", "r", "domain")}),
     l as ({_share(f"select k.*, {_case('k.lang', r.langs, r.other)} as w, d.x as b from (select domain, lang, sum(cap) as cap from leaf group by all) k join d using (domain)", "domain", "lang")}),
     s as ({_share(f"select k.*, {_case('k.source', r.sources, r.other)} as w, l.x as b from leaf k join l using (domain, lang)", "domain, lang", "source")}),
     plan as (select domain, lang, source, cast(floor(x + 1e-6) as bigint) // tokens as whole, cast(floor(x + 1e-6) as bigint) % tokens as rest from s),
     rows as (select n.*, whole, rest, md5(concat_ws('|', '{r.seed}', cast(whole as varchar), coalesce(cast(doc_id as varchar), ''))) as place
              from n join plan using (domain, lang, source) where n > 0),
     sums as (select *, coalesce(sum(n) over (partition by domain, lang, source order by place range between unbounded preceding and current row exclude group), 0) as before
              from rows)
select doc_id, domain, lang, source, epoch
from (select doc_id, domain, lang, source, unnest(range(whole + case when before < rest then 1 else 0 end)) as epoch from sums)
"""


MIX_SQL = mix_sql()


def line_dedup_sql(min_chars: int, table: str = "documents") -> str:
    """Brute force: the text of every shortest long-enough window, all over the corpus; all but the first place of each text are deleted."""
    return f"""
with one as (select *, string_split(text, chr(10)) as l from {table}),
     line as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from one),
     total as (select *, sum(length(line)) over (partition by doc_id order by pos) as upto, upto - length(line) as before from line),
     win as (select a.doc_id, a.pos as s, min(b.pos) as e from total a join total b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto - a.before >= {min_chars} group by 1, 2
             union
             select a.doc_id, max(a.pos) as s, b.pos as e from total a join total b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto - a.before >= {min_chars} group by 1, 3),
     named as (select win.*, array_to_string(l[s + 1 : e + 1], chr(10)) as run from win join one using (doc_id)),
     later as (select *, row_number() over (partition by run, e - s order by doc_id, s) as k from named),
     gone as (select distinct doc_id, unnest(range(s, e + 1)) as pos from later where k > 1),
     kept as (select doc_id, string_agg(line, chr(10) order by pos) as text from line anti join gone using (doc_id, pos) group by 1),
     hit as (select distinct doc_id from gone)
select o.doc_id, k.text, o.lang, o.source, case when h.doc_id is null then o.n_chars else length(k.text) end as n_chars
from {table} o join kept k using (doc_id) left join hit h using (doc_id)
"""


def similar_pairs_sql(threshold: float, table: str = "documents") -> str:
    """Brute force over all pairs that share a word trigram: sets s (k, ids) and their similar pairs p (u, v, j)."""
    return f"""
     w as (select doc_id, [x for x in string_split_regex(lower(text), '\\s+') if x <> ''] as w from {table} where doc_id is not null and text is not null),
     g as (select doc_id, list_sort(list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')]
                  else [concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)] end)) as g
           from w where len(w) > 0),
     s as materialized (select g, list_sort(list_distinct(list(doc_id))) as ids, row_number() over () as k from g group by g),
     e as (select k, len(g) as n, unnest(g) as t from s),
     p as (select * from (select a.k as u, b.k as v, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as j from e a join e b on a.t = b.t and a.k < b.k group by 1, 2) where j >= {threshold})
"""


def ngram_join_sql(threshold: float, table: str = "documents") -> str:
    """Classes are found by walking along the pairs."""
    return f"""
with recursive {similar_pairs_sql(threshold, table)},
     edge as (select u, v from p union all select v, u from p),
     reach as (select k as x, k as y from s union select r.x, e.v from reach r join edge e on e.u = r.y),
     class as (select x as k, min(s.ids[1]) as class_id from reach join s on s.k = reach.y group by 1),
     other as (select e.u as k, sum(len(s.ids)) as n from edge e join s on s.k = e.v group by 1),
     known as (select s.k, s.ids, class_id, len(s.ids) - 1 + coalesce(n, 0) as links from s join class using (k) left join other using (k))
select unnest(ids) as doc_id, class_id, cast(links as bigint) as links from known where links > 0
"""


def license_sql(templates: tuple = TEMPLATES, slack: int = SLACK, table: str = "documents") -> str:
    """Brute force: every place of every text against every template; templates have one or two phrases here."""
    assert all(len(t.words) <= 2 for t in templates)
    array = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n            ".join(f"('{t.license}', {array(t.words[0])}, {array(t.words[1]) if len(t.words) > 1 else 'cast([] as varchar[])'})" for t in templates)
    return f"""
with t(license, p, q) as (values {rows}),
     w as (select row_number() over () as k, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {table} where text is not null),
     f as (select list(distinct p[1]) as f from t),
     places as (select k, doc_id, w, unnest([i for i in range(1, len(w) + 1) if list_contains(f, w[i])]) as i from w, f),
     hit as (select distinct k, doc_id, license, i from places join t on w[i] = p[1] and w[i : i + len(p) - 1] = p
             where len(q) = 0 or len([g for g in range(0, {slack} + 1) if w[i + len(p) + g : i + len(p) + g + len(q) - 1] = q]) > 0)
select doc_id, license, cast(count(*) as integer) as n_notices, cast(min(i) - 1 as integer) as first_word from hit group by k, doc_id, license
"""


LICENSE_SQL = license_sql()
