"""DuckDB oracle SQL for the registered queries.

Each oracle is written independently of the Spark plan (lists and
correlated sub-queries where the Spark side uses running windows), over the
same adapter views, which are spelled out here as CTE text.
"""

from __future__ import annotations

from jobtrails.functions.location import STATE_ABBREV

_states = sorted(STATE_ABBREV.items())
_place_sql = f"""['springfield', 'salem', 'mount airy', 'fairview', 'new castle', 'saint paul', 'west point', 'north bend',
              'Clinton', 'porto alegre', 'washington'][c_custkey * 7 % 11 + 1] as place,
             {[n for n, _ in _states]}[c_custkey * 13 % {len(_states)} + 1] as state,
             {[c for _, c in _states]}[c_custkey * 13 % {len(_states)} + 1] as code"""

VIEWS = {
    "jobs_v": """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as job_id,
       o_custkey as person_id,
       row_number() over (partition by o_custkey
                          order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as pos,
       case when (l_orderkey + l_linenumber) % 11 = 0 then null
            else cast(date_trunc('month', least(o_orderdate, l_shipdate)) as date) end as start_dt,
       case when (l_orderkey + l_partkey) % 7 = 0 then null
            else cast(date_trunc('month', greatest(o_orderdate, l_shipdate)) as date) end as end_dt,
       s_name as company, p_name as title, lower(p_type) as location
from lineitem
join orders on l_orderkey = o_orderkey
join part on l_partkey = p_partkey
join supplier on l_suppkey = s_suppkey""",
    "titles_v": """
select person_id, pos, cast(year(start_dt) as bigint) as start_year,
       case when pos % 9 = 0 then null
            else concat(title, ' (', location, ') #', cast(pos as varchar)) end as title
from jobs_v""",
    "events_v": """
select user_id as person_id,
       row_number() over (partition by user_id order by ts, event_id) as pos,
       event_id as job_id, event_type as title, value
from events""",
    "docs_v": """
select doc_id as job_id, source as person_id,
       row_number() over (partition by source order by doc_id) as pos, text as description, lang
from documents""",
    "topics_v": """
select vec_id as job_id, cast(floor(vec_id / 5) as bigint) as person_id, vec_id % 5 as pos,
       list_transform(embedding, lambda x: cast(abs(x) as double)) as embedding, label as state
from embeddings""",
    "trace_v": """
select job_id % 20 as iter, title as s1, s2, count(*) as n
from (select job_id, title, lead(title) over (partition by person_id order by pos) as s2
      from events_v) t
where s2 is not null group by job_id % 20, title, s2""",
    "cust_v": """
select c_custkey as resume_id, c_mktsegment as currency, c_acctbal as salary,
       c_nationkey as state_id from customer""",
    "locs_v": f"""
select job_id, case when (job_id // 12) % 3 = 0 then fixed when job_id % 97 <> 0 then
       [place || ' ' || lower(state), place || ', ' || code, place || lower(code), place, place || ' ' || state || ' USA',
        ' ' || place || '  ' || lower(code) || ' '][job_id % 6 + 1] end as location
from (select c_custkey as job_id, {_place_sql},
             ['boston ma', 'new york new york', 'New York, NY', 'austin texas usa', 'chapel hill north carolina',
              'old hickorytn', 'paris', 'chapelhill nc', '', ' san juan puerto rico ', 'washington dc',
              'charleston west virginia'][c_custkey % 12 + 1] as fixed from customer) z""",
    "topic_words_v": """
select l_partkey % 64 as topic, p_name as word, count(*) as n
from lineitem join part on l_partkey = p_partkey group by l_partkey % 64, p_name""",
    "addr_v": f"""
select job_id, case job_id % 5
         when 0 then place || ', ' || place || ' County, ' || state || ', ' || lpad(cast(job_id * 31 % 100000 as varchar), 5, '0')
                     || ', ' || country
         when 1 then place || ', ' || place || ' County, ' || state || ', ' || country
         when 2 then place || ', ' || state || ', ' || country
         when 3 then place || ', ' || country else country end as address
from (select cast(c_custkey as bigint) as job_id, {_place_sql}, ['USA', 'Canada', 'France'][c_custkey % 3 + 1] as country
      from customer) z""",
}

# which views each view needs first
_DEPS = {"titles_v": ["jobs_v"], "trace_v": ["events_v"]}


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the CTEs for ``views`` (and their dependencies)."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{v} as ({VIEWS[v]}\n)" for v in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


ORACLES: dict[str, str] = {}


def add(name: str, body: str, *views: str) -> None:
    ORACLES[name] = with_views(body, *views)


# ---------------------------------------------------------------- E1, E2, E12
add("transition_counts", """
select title, next_title, count(*) as n
from (select title, lead(title) over w as next_title, lead(1) over w as has_next
      from titles_v
      window w as (partition by person_id
                   order by cast(start_year as varchar) nulls first, title nulls first)) t
where has_next is not null
group by title, next_title""", "titles_v")

_EVENT_COUNTS = """
c as (select title, next_title, count(*) as n
      from (select title, lead(title) over w as next_title, lead(1) over w as has_next
            from events_v window w as (partition by person_id order by pos)) t
      where has_next is not null group by title, next_title),
k as (select count(distinct title) as k from events_v where title is not null)"""

add("transition_probs", f"""
with {_EVENT_COUNTS}
select c.title, c.next_title, c.n,
       round((cast(c.n as double) + 1) / (sum(c.n) over (partition by c.title) + cast(k.k as double)), 6) as prob,
       round(1 / (sum(c.n) over (partition by c.title) + cast(k.k as double)), 6) as prob_unseen
from c, k""", "events_v")

add("next_title_top3", f"""
with {_EVENT_COUNTS},
p as (select c.title, c.next_title, c.n,
             round((cast(c.n as double) + 1) / (sum(c.n) over (partition by c.title) + cast(k.k as double)), 6) as prob
      from c, k),
r as (select *, row_number() over (partition by title order by n desc, next_title asc nulls first) as rnk from p),
asked as (select distinct title from events_v where title is not null)
select a.title, cast(r.rnk as bigint) as rank, r.next_title, r.n, r.prob
from asked a left join (select * from r where rnk <= 3) r on a.title = r.title""", "events_v")


# ---------------------------------------------------------------- B: scalar functions
def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _clean_name_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')),"
            f" '[[:punct:]]', '', 'g'), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')"


add("clean_name", f"""
select page_id, coalesce({_clean_name_sql('html')}, '') as clean_html,
       coalesce({_clean_name_sql('url')}, '') as clean_url
from pages""")

add("company_key", f"""
with k as (
  select job_id,
         case when loc is not null and length({_strip_sql('loc')}) > 0
              then coalesce({_clean_name_sql('company')}, '') || ' (' || coalesce({_clean_name_sql('loc')}, '') || ')'
              else coalesce({_clean_name_sql('company')}, '') end as company_key
  from (select job_id, company, case when pos % 4 = 0 then ' \t' else location end as loc from jobs_v) j)
select job_id, company_key,
       {_strip_sql("case when strpos(company_key, ' (') > 0 then substr(company_key, 1, strpos(company_key, ' (') - 1) else company_key end")} as company,
       {_strip_sql("case when strpos(company_key, ' (') > 0 then rtrim(substr(company_key, strpos(company_key, ' (') + 2), ')') else '' end")} as location
from k""", "jobs_v")

add("make_month_date", """
with i as (select job_id,
                  case when pos % 3 = 0 then year(start_dt) - 1900 else year(start_dt) end as y0,
                  (month(start_dt) + pos) % 14 as m0
           from jobs_v),
n as (select job_id, case when y0 < 100 then y0 + 1900 else y0 end as y,
             case when m0 is null or m0 = 0 then 1 else m0 end as m from i)
select job_id, case when y is not null and m between 1 and 12 and y between 1 and 9999
                    then make_date(cast(y as integer), cast(m as integer), 1) end as d
from n""", "jobs_v")

add("clean_title", """
select person_id, pos, regexp_replace(lower(title), '[^a-zA-Z ]', '', 'g') as clean,
       regexp_replace(lower(title), '[A-Z ]{6,}[A-Z ]{6,}', '', 'g') as clean_loose
from titles_v""", "titles_v")

add("stint_years", """
select job_id, round(date_diff('day', start_dt, end_dt) / 365.25, 6) as years,
       printf('%.1f yrs', date_diff('day', start_dt, end_dt) / 365.25) as years_text
from jobs_v where start_dt is not null and end_dt is not null""", "jobs_v")

_WORDPUNCT_SQL = "regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}]+', 0)"


def _nostop_sql(x: str) -> str:
    from jobtrails.functions.text import STOPWORDS
    return (f"list_filter(list_transform(list_filter(regexp_split_to_array({x}, '[\\s\\p{{Z}}]+'),"
            f" lambda w: w <> ''), lambda w: lower(w)), lambda w: not list_contains({_sql_list(STOPWORDS)}, w))")


def _fp_sql(x: str) -> str:
    return f"cast(len({x}) as bigint) as n_tokens, md5(array_to_string({x}, ' ')) as tokens_md5"


add("tokens_wordpunct", f"select job_id, {_fp_sql(_WORDPUNCT_SQL)} from docs_v", "docs_v")
add("tokens_nostop", f"select job_id, {_fp_sql(_nostop_sql('description'))} from docs_v", "docs_v")
add("tokens_nostop_alpha", f"""
select job_id, {_fp_sql("list_filter(" + _nostop_sql('description') + ", lambda w: regexp_matches(w, '^\\p{L}+$'))")}
from docs_v""", "docs_v")


def _preprocess_sql(x: str) -> str:
    s = f"lower({_strip_sql(x)})"
    return (f"(case when (length({s}) - length(replace({s}, 'new york', ''))) / 8 >= 2 "
            f"then regexp_replace({s}, '(?s)^(.*)new york', '\\1NY') else {s} end) || ' United States of America'")


def _unconcat_sql(x: str) -> str:
    from jobtrails.functions.location import unconcat_pattern
    pat = unconcat_pattern()
    fixed = f"regexp_replace({x}, '{pat}', '\\1 \\2 United States of America')"
    return f"case when regexp_matches({x}, '{pat}') then {_preprocess_sql(fixed)} end"


add("preprocess_loc", f"""
select job_id, q as query, {_unconcat_sql('location')} as unconcat,
       case when ends_with(q, 'United States of America')
            then substr(q, 1, strpos(q, 'United States of America') - 1) end as stripped
from (select job_id, location, {_preprocess_sql('location')} as q from locs_v) t""", "locs_v")

add("address_parts", """
with p as (select job_id, string_split(address, ', ') as parts from addr_v),
z as (select job_id, case when len(parts) >= 2 and regexp_matches(parts[len(parts) - 1], '^\\p{N}+$')
                          then list_filter(parts, lambda x, i: i <> len(parts) - 1) else parts end as e
      from p)
select job_id,
       case when len(e) > 3 then e[len(e) - 3] when len(e) = 3 then e[len(e) - 2]
            when len(e) = 2 then e[len(e) - 1] end as city,
       case when len(e) >= 3 then e[len(e) - 1] end as state,
       case when len(e) >= 1 then e[len(e)] end as country
from z""", "addr_v")

add("where_like", """
select job_id, location from locs_v where location is not null and location like '% % %'""", "locs_v")


def _standardize_sql() -> str:
    from jobtrails.functions.location import (STATE_ABBREV, STATE_CODES, STATE_NAMES,
                                              TWO_WORD_FIRSTS, TWO_WORD_STATES)
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in sorted(STATE_ABBREV.items()))
    return f"""
with st(name, code) as (values {pairs}),
t as (select job_id,
             list_filter(regexp_split_to_array(upper({_strip_sql('location')}), '\\s+'), lambda x: x <> '') as toks
      from locs_v where location is not null),
p as (select job_id, toks,
             list_max(list_transform(toks, lambda x, i: case when list_contains({_sql_list(TWO_WORD_FIRSTS)}, x)
                                                             then i - 1 else -1 end)) as pos
      from t),
q as (select job_id, toks, pos, toks[pos + 1] || ' ' || toks[pos + 2] as pair from p),
m as (select job_id,
             case when pos >= 0 and pos + 1 <= len(toks) - 1 and list_contains({_sql_list(TWO_WORD_STATES)}, pair)
                  then list_filter(list_transform(toks, lambda x, i: case when i - 1 = pos then pair else x end),
                                   lambda x, i: i - 1 <> pos + 1)
                  else toks end as t2, len(toks) as n
      from q),
s as (select job_id, t2, n,
             list_max(list_transform(t2, lambda x, i: case when list_contains({_sql_list(STATE_NAMES + STATE_CODES)}, x)
                                                          then i - 1 else -1 end)) as spos
      from m)
select job_id,
       case when n > 0 and spos >= 0 then array_to_string(t2[1:spos], ' ') end as city,
       case when n > 0 and spos >= 0 then coalesce(st.code, t2[spos + 1]) end as state,
       case when n > 0 and spos >= 0 then array_to_string(t2[spos + 2:], ' ') end as country,
       case when n = 0 then 'empty' when spos < 0 then 'bad' else 'good' end as status
from s left join st on st.name = t2[spos + 1]"""


add("standardize_location", _standardize_sql(), "locs_v")


# ---------------------------------------------------------------- C: sequences and windows
def _stint_fill_sql(src: str) -> str:
    """C1 over relation ``src`` (correlated sub-queries for the date lookups)."""
    return f"""
select job_id, person_id, pos, company, title, location, cast(seq_pos as bigint) as seq_pos,
       case when s1 is null then coalesce((select max(a.dt) from (
                select person_id, s1 as dt from g_{src} where s1 is not null
                union all select person_id, e1 from g_{src} where e1 is not null) a
              where a.person_id = g.person_id and a.dt < g.e1), e1)
            else s1 end as start_dt,
       case when e1 is null then coalesce((select min(a.dt) from (
                select person_id, s1 as dt from g_{src} where s1 is not null
                union all select person_id, e1 from g_{src} where e1 is not null) a
              where a.person_id = g.person_id and a.dt > g.s1), s1)
            else e1 end as end_dt
from g_{src} g"""


def _stint_fill_ctes(src: str) -> str:
    """CTEs d_/f_/g_<src> that stage the first/last fixes of C1."""
    return f"""
d_{src} as (select *, row_number() over (partition by person_id order by coalesce(start_dt, end_dt), pos) as seq_pos,
                   count(*) over (partition by person_id) as cnt
            from {src} where start_dt is not null or end_dt is not null),
f_{src} as (select *, case when seq_pos = 1 and start_dt is null then end_dt else start_dt end as s1 from d_{src}),
g_{src} as (select *, case when seq_pos = cnt and end_dt is null then s1 else end_dt end as e1 from f_{src})"""


add("stint_fill", f"with {_stint_fill_ctes('jobs_v')}\n{_stint_fill_sql('jobs_v')}", "jobs_v")


add("run_grouping", """
with c as (select conv_id, turn, role, text,
                  case when row_number() over w = 1 or (lag(role) over w) is distinct from role
                       then 1 else 0 end as chg
           from conversations window w as (partition by conv_id order by turn)),
r as (select *, cast(sum(chg) over (partition by conv_id order by turn rows between unbounded preceding
                                     and current row) as bigint) as run_no from c)
select conv_id, turn, role, text, run_no, min(turn) over (partition by conv_id, run_no) as run_start from r""")

add("seq_flatten", f"""
select job_id, cast(len(t) as bigint) as n
from (select job_id, {_nostop_sql('description')} as t from docs_v) d where len(t) > 0""", "docs_v")

add("seq_unflatten", f"""
select job_id, {_fp_sql('t')}
from (select job_id, {_nostop_sql('description')} as t from docs_v) d where len(t) > 0""", "docs_v")

add("prev_next_links", """
select person_id, pos, job_id,
       coalesce(lag(job_id) over w, -1) as prev_job, coalesce(lead(job_id) over w, -1) as next_job
from events_v window w as (partition by person_id order by pos)""", "events_v")

add("title_sequences", """
with b as (select *, count(*) over (partition by person_id) as n_jobs,
                  case when title is not null and title <> ''
                       then regexp_replace(lower(title), '[^a-zA-Z ]', '', 'g') end as ct
           from titles_v),
c as (select *, last_value(ct ignore nulls) over w as v,
             coalesce(last_value(start_year ignore nulls) over w, 0) as y
      from b where n_jobs >= 2
      window w as (partition by person_id order by pos rows between unbounded preceding and current row)),
d as (select * from c where v is not null and v <> ''),
e as (select *, row_number() over (partition by person_id order by y, pos) as seq_pos,
             count(*) over (partition by person_id) as seq_len from d)
select person_id, cast(seq_pos as bigint) as seq_pos, cast(y as bigint) as start_year, v as title,
       cast(seq_len as bigint) as seq_len
from e where seq_len >= 2""", "titles_v")

add("desc_sequences", f"""
with b as (select *, count(*) over (partition by person_id) as n_jobs,
                  case when description is not null then {_nostop_sql('description')} end as ct
           from docs_v),
c as (select *, last_value(ct ignore nulls) over w as v
      from b where n_jobs >= 2
      window w as (partition by person_id order by pos rows between unbounded preceding and current row)),
d as (select * from c where v is not null),
e as (select *, row_number() over (partition by person_id order by pos) as seq_pos,
             count(*) over (partition by person_id) as seq_len from d)
select person_id, cast(seq_pos as bigint) as seq_pos, {_fp_sql('v')}, cast(seq_len as bigint) as seq_len
from e where seq_len >= 2""", "docs_v")

add("length_histogram", """
with l as (select person_id, count(*) as n from events_v group by person_id),
c as (select least(n, 60) as length, count(*) as n_seqs from l group by 1),
b as (select range as length from range(0, 61)),
h as (select b.length, coalesce(c.n_seqs, 0) as n_seqs from b left join c on b.length = c.length)
select length, cast(n_seqs as bigint) as n_seqs, round(n_seqs / sum(n_seqs) over (), 6) as share from h""",
    "events_v")

add("mass_cutoff", """
with r as (select topic, word, n, sum(n) over (partition by topic) as total,
             coalesce(sum(n) over (partition by topic order by n desc, word desc
                                   rows between unbounded preceding and 1 preceding), 0) as before,
             row_number() over (partition by topic order by n desc, word desc) as rank
      from topic_words_v)
select topic, word, n, round(cast(n as double) / total, 6) as weight, cast(rank as bigint) as rank
from r where 2 * before <= total""",
    "topic_words_v")

add("topk_per_group", """
select topic, word, n, cast(rank as bigint) as rank
from (select *, row_number() over (partition by topic order by n desc, word asc) as rank from topic_words_v) t
where rank <= 10""", "topic_words_v")


# ---------------------------------------------------------------- E: statistics
def _top_labels_sql(labels: list[str]) -> str:
    cols = ", ".join(labels)
    order = ", ".join(f"{c} asc nulls first" for c in labels)
    sel = ", ".join(f"coalesce({_clean_name_sql(c)}, '') as {c}" for c in labels)
    return f"""
with j as (select {sel} from jobs_v),
c as (select {cols}, count(*) as n from j group by {cols}),
r as (select *, row_number() over (order by n desc, {order}) as rank from c)
select cast(rank as bigint) as rank, {cols}, n, round(n / (select count(*) from jobs_v), 6) as share
from r where rank <= 50"""


add("top_company", _top_labels_sql(["company"]), "jobs_v")
add("top_title", _top_labels_sql(["title"]), "jobs_v")
add("top_company_title", _top_labels_sql(["company", "title"]), "jobs_v")

add("attr_histograms", """
with l as (select 'currency' as attr, currency as value from cust_v
           union all select 'salary', cast(salary as varchar) from cust_v
           union all select 'state_id', cast(state_id as varchar) from cust_v),
c as (select attr, value, count(*) as n from l group by attr, value),
r as (select *, row_number() over (partition by attr order by n desc, value asc nulls first) as rk from c),
f as (select attr, case when rk < 10 then value else '* other *' end as value, sum(n) as n from r group by 1, 2),
p as (select attr, sum(n) as p from c group by attr)
select attr, value, cast(n as bigint) as n from f
union all
select attr, '* missing *', cast((select count(*) from cust_v) - p as bigint) from p
where p < (select count(*) from cust_v)""", "cust_v")

_JOBS_PER = "select person_id, count(*) as n_jobs from jobs_v group by person_id having count(*) < 21"
add("jobs_per_resume", _JOBS_PER, "jobs_v")
add("count_stats", f"""
select round(avg(n_jobs), 6) as mean, round(quantile_cont(n_jobs, 0.5), 6) as median,
       cast(count(*) filter (where n_jobs > 1) as bigint) as n_above, cast(count(*) as bigint) as n
from ({_JOBS_PER}) t""", "jobs_v")

add("salary_stats", """
select round(avg(s), 6) as mean, round(quantile_cont(s, 0.5), 6) as median, min(s) as min, max(s) as max
from (select cast(trunc(salary) as bigint) as s from cust_v
      where currency = 'BUILDING' and salary is not null) t""", "cust_v")

add("currency_counts", """
select currency, count(*) as n, round(log10(count(*)), 6) as log10_n from cust_v group by currency""",
    "cust_v")

add("value_histogram", """
select cast(floor(salary / 100) as bigint) as bin, count(*) as n
from cust_v where salary < 10000 group by 1""", "cust_v")

add("title_histogram", "select title, count(*) as n from titles_v group by title", "titles_v")

add("locations_by_size", """
select location, count(*) as n from locs_v where location is not null and location like '% %'
group by location order by n desc, location asc limit 5""", "locs_v")

_COUNTRY_LOCS = """
with l as (select lower(c_mktsegment) || ' ' || lower(n_name) as location,
                  case when c_custkey % 4 <> 0 then n_name end as country
           from customer join nation on c_nationkey = n_nationkey)
select location, count(*) as n from l where """

add("locations_blank_country", _COUNTRY_LOCS + "country is null group by location")
add("locations_other_country", _COUNTRY_LOCS + "country <> 'UNITED STATES' group by location")

add("max_id_where", "select max(job_id) as max_id from locs_v where location like '%new york%'", "locs_v")

_TRACE_MEAN = """
select s1, s2, sum(n) / (select count(distinct iter) from trace_v where iter >= {burn} and iter % {lag} = 0) as mean
from trace_v where iter >= {burn} and iter % {lag} = 0 group by s1, s2"""

add("trace_mean", f"""
select s1, s2, round(mean, 6) as mean from ({_TRACE_MEAN.format(burn=4, lag=2)}) t""", "trace_v")

add("trace_mode_state", """
select person_id, title as state
from (select person_id, title, row_number() over (partition by person_id order by count(*) desc, title asc) as r
      from events_v group by person_id, title) t
where r = 1""", "events_v")

add("top_transitions", f"""
select cast(row_number() over (order by mean desc, s1 desc, s2 desc) as bigint) as rank, s1, s2,
       round(mean, 6) as mean
from ({_TRACE_MEAN.format(burn=0, lag=1)}) m where s1 <> s2
order by mean desc, s1 desc, s2 desc limit 101""", "trace_v")

add("state_mobility", f"""
with m as ({_TRACE_MEAN.format(burn=0, lag=1)}),
d as (select *, coalesce(sum(mean) over (partition by s1 order by mean desc, s2 asc
                                         rows between unbounded preceding and 1 preceding), 0)
                / sum(mean) over (partition by s1) as bs
      from m where s1 <> s2),
c as (select s1, cast(case when max(mean) > 0 then count(*) end as bigint) as n_states
      from d where bs <= 0.5 group by s1)
select * from (select 'most' as kind, cast(row_number() over (order by n_states desc nulls last, s1 asc) as bigint) as rank,
                      s1 as state, n_states from c) a where rank <= 20
union all
select * from (select 'least' as kind, cast(row_number() over (order by n_states asc nulls last, s1 asc) as bigint) as rank,
                      s1 as state, n_states from c) b where rank <= 20""", "trace_v")

_VOCAB = """
with multi as (select *, count(*) over (partition by person_id) as nj from titles_v),
counted as (select regexp_replace(lower(title), '[^a-zA-Z ]', '', 'g') as title
            from multi where nj >= 2 and title is not null and title <> ''),
counts as (select title, count(*) as count from counted group by title),
b as (select *, count(*) over (partition by person_id) as n_jobs,
             case when title is not null and title <> ''
                  then regexp_replace(lower(title), '[^a-zA-Z ]', '', 'g') end as ct from titles_v),
c as (select *, last_value(ct ignore nulls) over w as v,
             coalesce(last_value(start_year ignore nulls) over w, 0) as y
      from b where n_jobs >= 2
      window w as (partition by person_id order by pos rows between unbounded preceding and current row)),
d as (select * from c where v is not null and v <> ''),
e as (select *, row_number() over (partition by person_id order by y, pos) as seq_pos,
             count(*) over (partition by person_id) as seq_len from d),
seqs as (select person_id, seq_pos, v as title from e where seq_len >= 2),
used as (select distinct title from seqs),
v as (select counts.*, used.title is not null as is_used from counts left join used on counts.title = used.title),
vocab as (select title, count, cast(row_number() over (order by count desc, title asc) as bigint) as id
          from v where count >= 10 and is_used
          union all select title, count, cast(0 as bigint) from v where not (count >= 10 and is_used))"""

add("vocab_encode", _VOCAB + "\nselect title, count, id from vocab", "titles_v")
add("vocab_encoded_sequences", _VOCAB + """
select s.person_id, cast(s.seq_pos as bigint) as seq_pos, coalesce(vocab.id, 0) as id
from seqs s left join vocab on s.title = vocab.title""", "titles_v")

add("merge_counts", f"""
select title, cast(count(*) as bigint) as n
from (select unnest({_nostop_sql('description')}) as title from docs_v) t group by title""", "docs_v")


# ---------------------------------------------------------------- D: joins
def _company_key_sql(company: str, loc: str) -> str:
    return (f"case when {loc} is not null and length({_strip_sql(loc)}) > 0 "
            f"then coalesce({_clean_name_sql(company)}, '') || ' (' || coalesce({_clean_name_sql(loc)}, '') || ')' "
            f"else coalesce({_clean_name_sql(company)}, '') end")


def _split_company_sql(key: str) -> tuple[str, str]:
    comp = _strip_sql(f"case when strpos({key}, ' (') > 0 then substr({key}, 1, strpos({key}, ' (') - 1) else {key} end")
    loc = _strip_sql(f"case when strpos({key}, ' (') > 0 then rtrim(substr({key}, strpos({key}, ' (') + 2), ')') else '' end")
    return comp, loc


_PC, _PL = _split_company_sql("ck")

_MATCH = f"""
with probe_src as (select * replace (case when person_id % 7 = 0 then '' else location end as location) from jobs_v),
{_stint_fill_ctes('jobs_v')},
{_stint_fill_ctes('probe_src')},
t as ({_stint_fill_sql('jobs_v')}),
p as ({_stint_fill_sql('probe_src')}),
tk as (select person_id, list_sort(list(struct_pack(s := start_dt, e := end_dt,
                                                    c := coalesce({_clean_name_sql('company')}, ''),
                                                    l := coalesce({_clean_name_sql('location')}, '')))) as k
       from t group by person_id),
owners as (select k, min(person_id) as table_seq, count(*) as n from tk group by k),
pck as (select *, {_company_key_sql('company', 'location')} as ck from p),
pk as (select person_id, list_sort(list(struct_pack(s := start_dt, e := end_dt, c := {_PC}, l := {_PL}))) as k
       from pck group by person_id),
firsts as (select k, min(person_id) as probe_seq from pk group by k),
pairs as (select probe_seq, table_seq from firsts join owners on firsts.k = owners.k)"""

add("match_by_fingerprint", _MATCH + """
select p.person_id as probe_seq, p.seq_pos, pairs.table_seq, t.job_id as table_job
from p join pairs on p.person_id = pairs.probe_seq
join t on t.person_id = pairs.table_seq and t.seq_pos = p.seq_pos""", "jobs_v")

add("match_counts", _MATCH + """
select cast((select count(*) from pairs) as bigint) as hits,
       cast((select count(*) from pk) - (select count(*) from pairs) as bigint) as misses,
       cast(coalesce((select sum(n - 1) from owners), 0) as bigint) as collisions""", "jobs_v")

add("align_positional", f"""
with right_src as (select * replace (
        case when pos % 13 = 0 then null else start_dt end as start_dt,
        case when pos % 13 = 0 then null when pos % 5 = 0 then null else end_dt end as end_dt) from jobs_v),
{_stint_fill_ctes('jobs_v')},
{_stint_fill_ctes('right_src')},
l as ({_stint_fill_sql('jobs_v')}),
r as ({_stint_fill_sql('right_src')}),
ll as (select person_id, count(*) as n from l group by person_id),
rl as (select person_id, count(*) as n from r group by person_id),
j as (select coalesce(l.person_id, r.person_id) as person_id, coalesce(l.seq_pos, r.seq_pos) as seq_pos,
             l.job_id as l_job, r.job_id as r_job, l.start_dt as ls, l.end_dt as le, r.start_dt as rs, r.end_dt as re
      from l full outer join r on l.person_id = r.person_id and l.seq_pos = r.seq_pos)
select j.person_id, j.seq_pos, l_job, r_job,
       case when coalesce(ll.n, 0) <> coalesce(rl.n, 0) then 'bad_length'
            when ls is not distinct from rs and le is not distinct from re then 'match' else 'bad_job' end as status
from j left join ll on ll.person_id = j.person_id left join rl on rl.person_id = j.person_id""", "jobs_v")

_LINKS = """
with d as (select person_id, pos, company, coalesce(year(start_dt), year(end_dt)) as s, year(end_dt) as e
           from jobs_v where coalesce(start_dt, end_dt) is not null),
links as (select a.person_id as id1, b.person_id as id2, a.company
          from d a join d b on a.company = b.company
           and (a.person_id < b.person_id or (a.person_id = b.person_id and a.pos < b.pos))
          where case when a.s <= b.s then a.e is not null and b.s <= a.e
                     else b.e is not null and a.s < b.e end)"""

add("coworker_links", _LINKS + "\nselect company, count(*) as n_links from links group by company", "jobs_v")
add("coworker_degree", _LINKS + """,
deg as (select person_id, count(*) as degree
        from (select id1 as person_id from links union all select id2 from links) x group by person_id)
select cast(row_number() over (order by degree desc, person_id asc) as bigint) as rank, person_id, degree
from deg order by degree desc, person_id asc limit 50""", "jobs_v")

add("shared_employers", f"""
with {_stint_fill_ctes('jobs_v')},
t as ({_stint_fill_sql('jobs_v')}),
pairs as (select distinct least(a.person_id, b.person_id) as p1, greatest(a.person_id, b.person_id) as p2, a.company
          from t a join t b on a.company = b.company and a.person_id <> b.person_id
          where b.start_dt < a.end_dt and a.start_dt < b.end_dt),
ends as (select p1 as person_id, p2 as other, company from pairs
         union all select p2, p1, company from pairs)
select person_id, count(distinct other) as n_partners, count(*) as n_links from ends group by person_id""", "jobs_v")


add("shared_employer_counts", f"""
with {_stint_fill_ctes('jobs_v')},
t as ({_stint_fill_sql('jobs_v')}),
o as (select *, max(end_dt) over (partition by person_id, company order by start_dt, end_dt
                                  rows between unbounded preceding and 1 preceding) as reach
      from t where start_dt is not null and end_dt >= start_dt and company is not null),
g as (select *, sum(case when reach > start_dt then 0 else 1 end) over (
               partition by person_id, company order by start_dt, end_dt rows unbounded preceding) as run from o),
m as (select person_id, company, min(start_dt) as s, max(end_dt) as e from g group by person_id, company, run),
pairs as (select a.company, count(*) as n from m a join m b on a.company = b.company and a.person_id < b.person_id
          and b.s < a.e and a.s < b.e group by a.company)
select m.company, count(distinct person_id) as n_people, count(*) as n_intervals,
       cast(coalesce(max(pairs.n), 0) as bigint) as n_overlaps
from m left join pairs on pairs.company = m.company group by m.company""", "jobs_v")


add("shared_employer_pairs", f"""
with {_stint_fill_ctes('jobs_v')},
sf as ({_stint_fill_sql('jobs_v')}),
x as (select person_id, start_dt as s, end_dt as e, company from sf where start_dt is not null and end_dt is not null)
select distinct least(a.person_id, b.person_id) as person1, greatest(a.person_id, b.person_id) as person2, a.company
from x a join x b on a.person_id = (select min(person_id) from sf) and b.person_id <> a.person_id
                 and a.company = b.company and b.s < a.e and a.s < b.e""", "jobs_v")


def _gazetteer_sql() -> str:
    from jobtrails.sources.gazetteer import rows
    vals = ", ".join("(" + ", ".join(("'" + v.replace("'", "''") + "'") if isinstance(v, str) else f"cast({v!r} as double)"
                                     for v in r) + ")" for r in rows())
    return f"gaz(key, city, state, country, latitude, longitude) as (values {vals})"


add("gazetteer_geocode", f"""
with {_gazetteer_sql()},
dl as (select distinct location from locs_v where location is not null),
k as (select location, {_preprocess_sql('location')} as k0, {_preprocess_sql(_unconcat_sql('location'))} as k1 from dl),
g as (select k.location,
             case when g0.key is not null then g0.city else g1.city end as city,
             case when g0.key is not null then g0.state else g1.state end as state,
             case when g0.key is not null then g0.country else g1.country end as country,
             case when g0.key is not null then g0.latitude else g1.latitude end as latitude,
             case when g0.key is not null then g0.longitude else g1.longitude end as longitude,
             case when g0.key is not null then 0 when g1.key is not null then 1 end as matched_by
      from k left join gaz g0 on g0.key = k.k0 left join gaz g1 on g1.key = k.k1)
select l.job_id, l.location, g.city, g.state, g.country, g.latitude, g.longitude, g.matched_by
from locs_v l left join g on l.location = g.location""", "locs_v")

_TOKS = "list_filter(regexp_split_to_array(lower({x}), '[\\s\\p{{Z}}]+'), lambda w: w <> '')"

add("compound_place_fix", f"""
with top as (select location, count(*) as n from locs_v where location like '% % %'
             group by location order by n desc, location asc limit 20000),
tk as (select n, location, {_TOKS.format(x=_strip_sql('location'))} as t from top),
d as (select n, location, t[1] || t[2] as squished, t[1] || ' ' || t[2] as unsquished from tk where len(t) >= 2),
dict as (select squished, unsquished
         from (select *, row_number() over (partition by squished order by n asc, location desc) as r from d) x
         where r = 1),
l as (select job_id, location, {_TOKS.format(x=_strip_sql('location'))} as t from locs_v)
select l.job_id, l.location,
       case when dict.unsquished is not null then
            {_preprocess_sql("case when len(t) > 1 then dict.unsquished || ' ' || array_to_string(t[2:], ' ') else dict.unsquished end")}
       end as compound_fix
from l left join dict on dict.squished = l.t[1]""", "locs_v")

add("job_transition_probs", f"""
with m as ({_TRACE_MEAN.format(burn=0, lag=1)}),
k as (select count(distinct title) as k from events_v),
p as (select s1, s2, round((mean + 1) / (sum(mean) over (partition by s1) + k.k), 6) as prob,
             round(1 / (sum(mean) over (partition by s1) + k.k), 6) as pu from m, k),
u as (select distinct s1, pu from p),
pairs as (select job_id as job_id1, lead(job_id) over w as job_id2, title as state1, lead(title) over w as state2,
                 lead(1) over w as hn
          from events_v window w as (partition by person_id order by pos))
select job_id1, job_id2, state1, state2, coalesce(p.prob, u.pu) as trans_prob
from pairs left join p on p.s1 = state1 and p.s2 = state2 left join u on u.s1 = state1
where hn is not null""", "events_v", "trace_v")

add("state_word_mix", """
with x as (select state, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as topic from topics_v),
st as (select state, cast(topic as bigint) as topic, sum(x) as mass from x group by state, topic),
sh as (select *, mass / sum(mass) over (partition by state) as share from st),
tw as (select topic, word, cast(n as double) / sum(n) over (partition by topic) as weight from topic_words_v),
twr as (select * from (select *, row_number() over (partition by topic order by weight desc, word desc) as r from tw) y
        where r <= 500),
sc as (select state, word, sum(share * weight) as score from sh join twr on sh.topic = twr.topic group by state, word),
rk as (select *, row_number() over (partition by state order by score desc, word asc) as rank from sc)
select state, cast(rank as bigint) as rank, word, round(score, 6) as score from rk where rank <= 10""",
    "topics_v", "topic_words_v")

_TITLE_SEQS = """
b as (select *, count(*) over (partition by person_id) as n_jobs,
             case when title is not null and title <> ''
                  then regexp_replace(lower(title), '[^a-zA-Z ]', '', 'g') end as ct from titles_v),
c as (select *, last_value(ct ignore nulls) over w as v,
             coalesce(last_value(start_year ignore nulls) over w, 0) as y
      from b where n_jobs >= 2
      window w as (partition by person_id order by pos rows between unbounded preceding and current row)),
d as (select * from c where v is not null and v <> ''),
e as (select *, row_number() over (partition by person_id order by y, pos) as seq_pos,
             count(*) over (partition by person_id) as seq_len from d),
seqs as (select person_id, cast(seq_pos as bigint) as seq_pos, v as title from e where seq_len >= 2),
cut as (select max(person_id) as cut from (select distinct person_id from seqs order by person_id limit 50) x),
s as (select seqs.*, case when person_id <= cut then 'train' else 'test' end as split from seqs, cut)"""

add("split_sequences", f"with {_TITLE_SEQS}\nselect person_id, seq_pos, split from s", "titles_v")
add("unseen_anti", f"""
with {_TITLE_SEQS},
h as (select person_id, title, case when cast('0x' || substr(md5(cast(person_id as varchar)), 1, 4) as integer) % 100 < 2
                                    then 'train' else 'test' end as split from seqs)
select title, count(*) as n from h
where split = 'test' and title not in (select title from h where split = 'train')
group by title""", "titles_v")


# ---------------------------------------------------------------- A: sources and sinks
_FLAG_COLUMNS = ["wants_permanent", "wants_contract", "wants_intern", "wants_temp", "wants_full_time",
                 "wants_part_time", "wants_per_diem", "wants_overtime", "wants_weekends", "prefer_weekends",
                 "wants_seasonal", "will_relocate"]


def _xml_people_sql() -> str:
    from jobtrails.functions.location import STATE_CODES
    flag_vals = ["true", "false", "true", "false", "true", "null"]
    flags = []
    for i, column in enumerate(_FLAG_COLUMNS):
        cases = " ".join(f"when {j} then {v}" for j, v in enumerate(flag_vals))
        flags.append(f"case (c_custkey + {i}) % 6 {cases} end as {column}")
    codes = _sql_list(STATE_CODES)
    return f"""
people as (
  select c.*, n.n_name, n.n_nationkey,
         {codes}[(n.n_nationkey % {len(STATE_CODES)}) + 1] as code,
         {", ".join(flags)}
  from customer c join nation n on c.c_nationkey = n.n_nationkey)"""


add("src_xml_resumes", f"""
with {_xml_people_sql()},
nj as (select person_id, count(*) as n from jobs_v group by person_id)
select cast(c_custkey as integer) as resume_id, coalesce(nj.n, 0) as n_experience, cast(1 as bigint) as n_education,
       cast(case when c_custkey % 3 = 0 then 3 else 2 end as bigint) as n_locations
from people left join nj on nj.person_id = people.c_custkey""", "jobs_v")

add("etl_resumes", f"""
with {_xml_people_sql()}
select cast(c_custkey as integer) as resume_id,
       wants_permanent, wants_contract, wants_intern, wants_temp, wants_full_time, wants_part_time,
       wants_per_diem, wants_overtime, wants_weekends, prefer_weekends, wants_seasonal, will_relocate,
       c_mktsegment as currency_name, cast(null as varchar) as additional_info, c_name as resume_title,
       cast(null as varchar) as summary,
       case when c_custkey % 5 = 0 then 'Up to 25% travel' end as willingness_to_travel_internal_name,
       make_date(cast(2000 + c_custkey % 10 as integer), cast(c_custkey % 12 + 1 as integer),
                 cast(c_custkey % 28 + 1 as integer)) as date_created,
       make_date(cast(2000 + c_custkey % 10 as integer), cast(c_custkey % 12 + 1 as integer),
                 cast(c_custkey % 28 + 1 as integer)) as date_modified,
       coalesce({_clean_name_sql("c_name || '!'")}, '') as desired_job_title,
       c_acctbal as salary, cast(c_nationkey as integer) as commute_distance,
       case when c_custkey % 3 = 0 then array_to_string(list_sort(list_distinct([code, 'MA'])), ',')
            else code end as state
from people""")

def _schema_paths_sql() -> str:
    """The elements of the résumé documents, by parent."""
    tree = {
        "resume": "Badge CommuteDistance CurrencyName DateCreated DateModified DesiredJobTitle PreferWeekends ResumeID "
                  "ResumeTitle Salary WantsContract WantsFullTime WantsIntern WantsOvertime WantsPartTime WantsPerDiem "
                  "WantsPermanent WantsSeasonal WantsTemp WantsWeekends WillRelocate WillingnessToTravelInternalName "
                  "education experience extras locations",
        "resume/education": "schoolrecord",
        "resume/education/schoolrecord": "City CompleteMonth CompleteYear GPA School SchoolId State",
        "resume/experience": "experiencerecord",
        "resume/experience/experiencerecord": "Company Description EndMonth EndYear Location StartMonth StartYear Title",
        "resume/extras": "extra",
        "resume/extras/extra": "Kind Level",
        "resume/locations": "location",
        "resume/locations/location": "StateAbbrev",
    }
    rows = ", ".join(f"('{parent}/{tag}', '{parent}')" for parent, tags in tree.items() for tag in tags.split())
    return f"select * from (values {rows}) t(path, parent)"


add("xml_schema_paths", _schema_paths_sql())

def _attr_histograms_xml_sql() -> str:
    """Every element with its children's values, by the fixture's formulas."""
    flag_values = "['True', 'False', '1', '0', 'TRUE', NULL]"
    tags = ("WantsPermanent WantsContract WantsIntern WantsTemp WantsFullTime WantsPartTime WantsPerDiem WantsOvertime "
            "WantsWeekends PreferWeekends WantsSeasonal WillRelocate").split()
    k = "c_custkey"
    half = f"case when {k} % 2 = 0 then 'AM' else 'PM' end"
    created = f"({k} % 12 + 1) || '/' || ({k} % 28 + 1) || '/' || (2000 + {k} % 10) || ' ' || ({k} % 12 + 1) || ':05:00 ' || {half}"
    of = {  # (element, source): (attr, value) of its children, a null value where there is none
        ("resume", "people left join nj on nj.person_id = c_custkey"): [
            ("ResumeID", f"cast({k} as varchar)"),
            *[(t, f"{flag_values}[({k} + {i}) % 6 + 1]") for i, t in enumerate(tags)],
            ("Salary", "cast(c_acctbal as varchar)"), ("CurrencyName", "c_mktsegment"),
            ("CommuteDistance", "cast(c_nationkey as varchar)"), ("DesiredJobTitle", "c_name || '!'"), ("ResumeTitle", "c_name"),
            ("WillingnessToTravelInternalName", f"case when {k} % 5 = 0 then 'Up to 25% travel' end"),
            ("DateCreated", created), ("DateModified", created),
            ("locations.location_count", f"case when {k} % 3 = 0 then '3' else '2' end"),
            ("experience.experiencerecord_count", "cast(nj.n as varchar)"), ("education.schoolrecord_count", "'1'"),
            ("Badge", f"case when {k} % 4 = 0 then 'badge ' || ({k} % 7) end"),
            ("extras.extra_count", f"case when {k} % 3 = 0 then '2' end")],
        ("resume/locations", "people, (select unnest([1, 2, 3]) as i) where i < 3 or c_custkey % 3 = 0"): [
            ("location.StateAbbrev_count", "'1'")],
        ("resume/locations/location", "people, (select unnest([1, 2, 3]) as i) where i < 3 or c_custkey % 3 = 0"): [
            ("StateAbbrev", "case when i < 3 then code else 'MA' end")],
        ("resume/education", "people"): [("schoolrecord.City_count", "'7'")],
        ("resume/education/schoolrecord", "people"): [
            ("City", "n_name"), ("State", "'Region'"), ("School", "'School of ' || n_name"), ("SchoolId", "cast(n_nationkey as varchar)"),
            ("CompleteYear", f"cast(1970 + {k} % 30 as varchar)"), ("CompleteMonth", f"cast({k} % 13 as varchar)"),
            ("GPA", f"printf('%.2f', ({k} % 400) / 100.0)")],
        ("resume/experience", "jobs"): [
            ("experiencerecord.Company_count", "cast(3 + (pos % 6 <> 0)::int + 2 * (start_dt is not null)::int"
                                               " + 2 * (end_dt is not null)::int as varchar)")],
        ("resume/experience/experiencerecord", "jobs"): [
            ("Company", "company"), ("Location", "location"), ("Title", "title"),
            ("Description", "case when pos % 6 <> 0 then title || ' work at ' || company end"),
            ("StartYear", "cast(year(start_dt) as varchar)"), ("StartMonth", "cast(month(start_dt) as varchar)"),
            ("EndYear", "cast(year(end_dt) as varchar)"), ("EndMonth", "cast(month(end_dt) as varchar)")],
        ("resume/extras", "people, (select unnest([1, 2]) as i) where c_custkey % 3 = 0"): [
            ("extra." + "Kind_count", "case when i = 1 then '2' else '1' end")],
        ("resume/extras/extra", "people, (select unnest([1, 2]) as i) where c_custkey % 3 = 0"): [
            ("Kind", "case when i = 1 then 'club' else 'prize' end"), ("Level", f"case when i = 1 then cast({k} % 5 as varchar) end")],
    }
    rows = " union all ".join(f"select '{e}' as element, '{a}' as attr, {v} as value from {src}"
                              for (e, src), kids in of.items() for a, v in kids)
    total = {"resume": "people", "resume/locations": "people", "resume/education": "people",
             "resume/experience": "(select distinct person_id from jobs)",
             "resume/extras": "(select 1 from people where c_custkey % 3 = 0)"}
    totals = " union all ".join(f"select '{e}' as element, (select count(*) from {total.get(e, src)}) as t" for e, src in of)
    return f"""
with {_xml_people_sql()},
jobs as (select j.* from jobs_v j join people p on p.c_custkey = j.person_id),
nj as (select person_id, count(*) as n from jobs group by person_id),
l as (select * from ({rows}) where value is not null),
tt as ({totals}),
c as (select element, attr, value, count(*) as n from l group by all),
r as (select *, row_number() over (partition by element, attr order by n desc, value asc) as rk from c),
f as (select element, attr, case when rk < 10 then value else '* other *' end as value, sum(n) as n from r group by all),
p as (select element, attr, sum(n) as p from c group by all)
select element, attr, value, cast(n as bigint) as n from f
union all
select element, attr, '* missing *', cast(t - p as bigint) from p join tt using (element) where p < t"""


add("attr_histograms_xml", _attr_histograms_xml_sql(), "jobs_v")

add("xml_bad_records", """
select case when c_custkey % 3 <> 0 then cast(c_custkey as varchar) end as resume_id,
       case when c_custkey % 3 = 0 then '<resume><ResumeID>' || c_custkey || '</Resume></resume>' end as record
from customer""")

add("parse_flags", f"""
with {_xml_people_sql()}
select cast(c_custkey as integer) as resume_id, wants_permanent, wants_contract, wants_intern, wants_temp,
       wants_full_time, wants_part_time, wants_per_diem, wants_overtime, wants_weekends, prefer_weekends,
       wants_seasonal, will_relocate
from people""")

add("state_list", f"""
with {_xml_people_sql()}
select cast(c_custkey as integer) as resume_id,
       case when c_custkey % 3 = 0 then array_to_string(list_sort(list_distinct([code, 'MA'])), ',')
            else code end as state
from people""")

add("snake_columns", f"""
with {_xml_people_sql()}
{" union all ".join(f"""select '{c}' as "column", count({c}) as n from people""" for c in _FLAG_COLUMNS)}
{"".join(f""" union all select '{c}', count(*) from people""" for c in
         ("resume_id", "currency_name", "resume_title", "date_created", "date_modified", "desired_job_title", "salary",
          "commute_distance"))}
union all select 'additional_info', 0 union all select 'summary', 0
union all select 'willingness_to_travel_internal_name', count(*) from people where c_custkey % 5 = 0""")

add("split_files", "select cast(c_custkey as integer) as resume_id from customer where c_custkey % 2 = 1")

_ETL_SRC = """
etl_src as (select cast(person_id as integer) as person_id, cast(pos - 1 as integer) as pos, start_dt, end_dt,
                   coalesce(""" + _clean_name_sql('company') + """, '') as company,
                   """ + _clean_name_sql('location') + """ as location,
                   """ + _clean_name_sql('title') + """ as title,
                   case when pos % 6 = 0 then '' else title || ' work at ' || company end as description
            from jobs_v)"""

add("etl_jobs", f"""
with {_ETL_SRC},
{_stint_fill_ctes('etl_src')}
select person_id as resume_id, pos, company as company_name, location, title, description,
       seq_pos, start_dt, end_dt
from ({_stint_fill_sql('etl_src').replace('select job_id, person_id, pos, company, title, location,',
                                          'select person_id, pos, company, title, location, description,')}) x""",
    "jobs_v")

add("etl_schools", f"""
select cast(c_custkey as integer) as resume_id, 0 as pos, cast(n_nationkey as integer) as school_id,
       {_clean_name_sql("'School of ' || n_name")} as school_name, {_clean_name_sql('n_name')} as city,
       'region' as state,
       make_date(cast(1970 + c_custkey % 30 as integer),
                 cast(case when c_custkey % 13 = 0 then 1 else c_custkey % 13 end as integer), 1) as grad_date,
       cast(printf('%.2f', (c_custkey % 400) / 100.0) as double) as gpa, cast(null as varchar) as summary
from customer join nation on c_nationkey = n_nationkey""")

add("seq_jsonl_roundtrip", f"""
with {_stint_fill_ctes('jobs_v')}
select person_id, seq_pos, start_dt, end_dt, company, title as description,
       cast(seq_pos as double) / 4 as t0, cast(length(title) as double) as t1
from ({_stint_fill_sql('jobs_v')}) x""", "jobs_v")

add("seq_load_limit", """
with l as (select person_id, count(*) as n from events_v group by person_id having count(*) >= 3),
r as (select *, coalesce(sum(n) over (order by person_id rows between unbounded preceding and 1 preceding), 0)
               as before from l)
select person_id, n, cast(before as bigint) as before from r where before <= 3000""", "events_v")

add("seq_scan_stats", """
with l as (select person_id, count(*) as n, max(len(embedding)) as width from topics_v group by person_id
           having count(*) >= 3),
r as (select *, coalesce(sum(n) over (order by person_id rows between unbounded preceding and 1 preceding), 0)
               as before from l),
k as (select * from r where before <= 1000)
select cast(count(*) as bigint) as n_seqs, cast(sum(n) as bigint) as n_entries,
       cast(arg_max(width, person_id) as integer) as width
from k""", "topics_v")

add("trace_latest", """
select cast(iter as bigint) as iter, s1, s2, n from trace_v where iter = (select max(iter) from trace_v)""",
    "trace_v")

add("trace_append", """
select cast(iter as bigint) as iter, cast(sum(n) as bigint) as n
from (select iter, n from trace_v union all select iter + 20, n from trace_v) t group by iter""", "trace_v")

add("topic_vectors_wide", "select job_id, " + ", ".join(
    f"round(embedding[{i + 1}], 6) as t{i}" for i in range(64)) + " from topics_v", "topics_v")

add("add_column", """
select job_id, location, cast(null as varchar) as city, cast(null as double) as latitude from locs_v""",
    "locs_v")

add("upsert_attrs", ORACLES["gazetteer_geocode"].replace(
    "select l.job_id, l.location, g.city, g.state, g.country, g.latitude, g.longitude, g.matched_by",
    "select l.job_id, l.location, g.city, g.state, g.country"))


# ---------------------------------------------------------------- text and topic models
add("doc_term_matrix", """
with t as (select job_id, unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}', 0)) as term
           from docs_v),
c as (select job_id, term, count(*) as n from t group by job_id, term)
select term, cast(sum(n) as bigint) as n, cast(count(*) as bigint) as n_docs from c group by term""", "docs_v")


def _bigram_stops() -> str:
    from jobtrails.functions.text import STOPWORDS
    return _sql_list(STOPWORDS)


def _bigram_sql() -> str:
    stops = _bigram_stops()
    cont = ["n_ii", "n_oi", "n_io", "n_oo"]
    terms = []
    for i in range(4):
        e = f"(({cont[i]} + {cont[i ^ 1]}) * ({cont[i]} + {cont[i ^ 2]}) / nn)"
        terms.append(f"{cont[i]} * ln({cont[i]} / ({e} + 1e-20) + 1e-20)")
    return f"""
with tk as (select job_id, {_WORDPUNCT_SQL} as t from docs_v),
tot as (select cast(sum(len(t)) as double) as nn from tk),
uni as (select w, count(*) as c from (select unnest(t) as w from tk) u group by w),
pos as (select job_id, unnest(t) as w, generate_subscripts(t, 1) as i from tk),
pairs as (select a.w as w1, b.w as w2 from pos a join pos b on a.job_id = b.job_id and b.i = a.i + 1),
big as (select w1, w2, count(*) as n from pairs
        where regexp_matches(w1, '^\\p{{L}}+$') and regexp_matches(w2, '^\\p{{L}}+$')
          and not list_contains({stops}, w1) and not list_contains({stops}, w2)
        group by w1, w2),
j as (select big.w1, big.w2, big.n, cast(big.n as double) as n_ii,
             cast(u2.c - big.n as double) as n_oi, cast(u1.c - big.n as double) as n_io, tot.nn
      from big join uni u1 on u1.w = big.w1 join uni u2 on u2.w = big.w2, tot),
s as (select w1, w2, n, 2.0 * ({' + '.join(terms)}) as score
      from (select *, nn - n_ii - n_oi - n_io as n_oo from j) x)
select w1, w2, n, round(score, 6) as score from s order by score desc, w1, w2 limit 1000"""


add("bigram_llr", _bigram_sql(), "docs_v")

def _joined_sql() -> str:
    """CTEs to ``jd`` (job_id, toks): each document as a string of marked
    tokens, over which its bigrams are replaced one after another, best first."""
    a, z = "chr(1)", "chr(2)"
    w1, w2 = "split_part(p, ' ', 1)", "split_part(p, ' ', 2)"
    body, _, _ = _bigram_sql().rpartition("\nselect")
    return body + f""",
bg as (select w1, w2, round(score, 6) as score from s order by s.score desc, w1, w2 limit 1000),
hit as (select a.job_id, a.w || ' ' || b.w as p, bg.score, min(a.i) as i
        from pos a join pos b on a.job_id = b.job_id and b.i = a.i + 1 join bg on bg.w1 = a.w and bg.w2 = b.w
        group by all),
rk as (select job_id, list(p order by score desc, i) as ps from hit group by job_id),
jd as (select tk.job_id, t, string_split(replace(replace(list_reduce(list_concat(
         [array_to_string(list_transform(t, lambda w: {a} || w || {z}), '')], coalesce(ps, [])),
         lambda d, p: replace(d, {a} || {w1} || {z} || {a} || {w2} || {z}, {a} || {w1} || '_' || {w2} || {z})),
         {z} || {a}, {z}), {a}, ''), {z}) as parts
       from tk left join rk using (job_id)),
jt as (select job_id, case when len(coalesce(t, [])) = 0 then [] else parts[:-2] end as toks from jd)"""


add("bigram_replace", f"""{_joined_sql()}
select job_id, cast(len(toks) as bigint) as n_tokens, md5(array_to_string(toks, ' ')) as tokens_md5 from jt""", "docs_v")

add("clean_descriptions", f"""{_joined_sql()},
fm as (select list(w1 || '_' || w2) as forms from bg)
select job_id, array_to_string(list_filter(toks, lambda w: (regexp_matches(w, '^\\p{{L}}+$') or list_contains(forms, w))
                               and not list_contains({{_stops}}, w)), ' ') as clean_text from jt, fm""".replace(
    "{_stops}", _bigram_stops()), "docs_v")

_NORM_TOPICS = """
nt as (select job_id, list_transform(embedding, lambda x: x / list_sum(embedding)) as v from topics_v),
tw as (select topic, word, cast(n as double) / sum(n) over (partition by topic) as weight from topic_words_v)"""

add("lda_topic_mass", """
select term as word, round(count(*) + 8 * (1.0 / 8), 4) as mass
from (select unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}', 0)) as term from docs_v) t
group by term""", "docs_v")

add("doc_top_topics", f"""
with {_NORM_TOPICS},
x as (select job_id, unnest(v) as weight, generate_subscripts(v, 1) - 1 as topic from nt),
xt as (select job_id, cast(topic as bigint) as topic, weight,
              row_number() over (partition by job_id order by weight desc, topic desc) as t_rank
       from x where weight >= 0.01),
w as (select topic, word, weight as freq,
             row_number() over (partition by topic order by weight desc, word desc) as w_rank from tw)
select job_id, cast(t_rank as bigint) as t_rank, xt.topic, round(xt.weight, 6) as weight,
       cast(w_rank as bigint) as w_rank, word, round(freq, 6) as freq
from xt join w on xt.topic = w.topic where w_rank <= 10""", "topics_v", "topic_words_v")

add("dominant_topic", """
with t as (select job_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as topic from topics_v),
l as (select topic, cast(dense_rank() over (order by topic) - 1 as bigint) as label from (select distinct topic from t) d)
select job_id, t.topic, label from t join l on t.topic = l.topic""", "topics_v")

add("state_topic_mix", f"""
with {_NORM_TOPICS},
x as (select state, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as topic from topics_v),
st as (select state, cast(topic as bigint) as topic, sum(x) as mass from x group by state, topic),
sh as (select *, mass / sum(mass) over (partition by state) as share,
              row_number() over (partition by state order by mass desc, topic desc) as t_rank from st),
w as (select topic, word, weight,
             row_number() over (partition by topic order by weight desc, word desc) as w_rank from tw)
select state, cast(t_rank as bigint) as t_rank, sh.topic, round(share, 6) as share,
       cast(w_rank as bigint) as w_rank, word, round(weight, 6) as freq
from sh join w on sh.topic = w.topic where t_rank <= 10 and w_rank <= 6""", "topics_v", "topic_words_v")


# ---------------------------------------------------------------- hidden Markov model with given parameters
def _hmm_ctes(source: str, label: str) -> tuple[str, list[list[float]]]:
    """The given model (three states) and, for every position of every history
    of ``source`` (person_id, pos, label), the recursions of the model."""
    S = range(3)
    w = [[1 + ((7 * i + 3 * j + 1) ** 2 * 0.1234567) % 1 + 2 * (i == j) for j in S] for i in S]
    A = [[x / sum(row) for x in row] for row in w]
    pi = [(1 + i) / 6 for i in S]
    num = lambda x: f"cast({x!r} as double)"
    into = [" + ".join(f"f.a{i} * {num(A[i][j])}" for i in S) for j in S]
    best = [f"greatest({', '.join(f'f.d{i} + ln({num(A[i][j])})' for i in S)})" for j in S]
    came = [" ".join(f"when f.d{i} + ln({num(A[i][j])}) = {best[j]} then {i}" for i in S) for j in S]
    beta = [" + ".join(f"{num(A[i][j])} * f.b{j} * f.e{j}" for j in S) for i in S]
    cols = lambda f: ", ".join(f(i) for i in S)
    return f"""
sy as (select {label} as label, row_number() over (order by {label}) - 1 as id from (select distinct {label} from {source}) z),
sw as (select label, id, {cols(lambda i: f"1 + ((({5 * i + 2} + 3 * id) * ({5 * i + 2} + 3 * id)) * cast(0.7654321 as double)) % 1 as w{i}")} from sy),
sb as (select label, id, {cols(lambda i: f"w{i} / sum(w{i}) over () as b{i}")} from sw),
ob as (select person_id, pos, id, b0, b1, b2, count(*) over (partition by person_id) as n from {source} join sb on sb.label = {label}),
fw as (
  select person_id, pos, n, id, {cols(lambda j: f"{num(pi[j])} * b{j} / c as a{j}")}, c, {cols(lambda j: f"ln({num(pi[j])}) + ln(b{j}) as d{j}")},
         {cols(lambda j: f"-1 as k{j}")}, b0 as e0, b1 as e1, b2 as e2
  from (select *, {' + '.join(f"{num(pi[j])} * b{j}" for j in S)} as c from ob where pos = 1) z
  union all
  select person_id, pos, n, id, {cols(lambda j: f"p{j} / c as a{j}")}, c, d0, d1, d2, k0, k1, k2, e0, e1, e2
  from (select *, p0 + p1 + p2 as c from (
    select o.person_id, o.pos, o.n, o.id, {cols(lambda j: f"({into[j]}) * o.b{j} as p{j}")},
           {cols(lambda j: f"{best[j]} + ln(o.b{j}) as d{j}")}, {cols(lambda j: f"case {came[j]} end as k{j}")},
           o.b0 as e0, o.b1 as e1, o.b2 as e2
    from fw f join ob o on o.person_id = f.person_id and o.pos = f.pos + 1) y) z),
bw as (
  select person_id, pos, cast(1 as double) as b0, cast(1 as double) as b1, cast(1 as double) as b2, e0, e1, e2, c from fw where pos = n
  union all
  select f.person_id, g.pos, {cols(lambda i: f"({beta[i]}) / f.c")}, g.e0, g.e1, g.e2, g.c
  from bw f join fw g on g.person_id = f.person_id and g.pos = f.pos - 1),
vp as (
  select person_id, pos, case when d0 >= d1 and d0 >= d2 then 0 when d1 >= d2 then 1 else 2 end as state from fw where pos = n
  union all
  select v.person_id, v.pos - 1, [g.k0, g.k1, g.k2][v.state + 1]
  from vp v join fw g on g.person_id = v.person_id and g.pos = v.pos where v.pos > 1)""", A


def _recursive(body: str, *views: str) -> str:
    return "with recursive" + with_views(body, *views).removeprefix("with")


_EV_CTES, _EV_A = _hmm_ctes("events_v", "title")

ORACLES["hmm_score_events"] = _recursive(f"""
with {_EV_CTES}
select person_id, round(sum(ln(c)), 6) as loglik from fw group by person_id""", "events_v")

ORACLES["hmm_path_events"] = _recursive(f"""
with {_EV_CTES}
select person_id, pos, state from vp""", "events_v")

ORACLES["hmm_decode_events"] = _recursive(f"""
with {_EV_CTES},
x as (select person_id, state as last_state, {[max(range(3), key=lambda j: row[j]) for row in _EV_A]}[state + 1] as next_state
      from vp join (select distinct person_id, n as pos from ob) using (person_id, pos)),
t as (select 0 as next_state, arg_max(label, b0) as next_title from sb union all select 1, arg_max(label, b1) from sb
      union all select 2, arg_max(label, b2) from sb)
select person_id, last_state, next_state, next_title from x join t using (next_state)""", "events_v")

ORACLES["hmm_em_step"] = _recursive(f"""
with {_EV_CTES},
g as (select fw.id, fw.pos, {", ".join(f"fw.a{i} * bw.b{i} as g{i}" for i in range(3))} from fw join bw using (person_id, pos)),
gl as ({" union all ".join(f"select id, pos, {i} as i, g{i} as g from g" for i in range(3))}),
xi as ({" union all ".join(f"select {i} as i, {j} as j, sum(f.a{i} * cast({_EV_A[i][j]!r} as double) * b.e{j} * b.b{j} / b.c) as x "
                           "from fw f join bw b on b.person_id = f.person_id and b.pos = f.pos + 1"
                           for i in range(3) for j in range(3))}),
r as (select 'start' as kind, i, 0 as j, sum(g) / (select sum(g) from gl where pos = 1) as value from gl where pos = 1 group by i
      union all
      select 'trans', i, j, x / sum(x) over (partition by i) from xi
      union all
      select 'emit', i, id, g / sum(g) over (partition by i) from (select i, id, sum(g) as g from gl group by i, id) z)
select kind, cast(i as integer) as i, cast(j as integer) as j, round(value, 6) as value from r""", "events_v")

_TOPIC_CTES, _ = _hmm_ctes("th", "topic")
ORACLES["hmm_topics_path"] = _recursive(f"""
with th as (select person_id, pos + 1 as pos, list_position(embedding, list_max(embedding)) - 1 as topic from topics_v),
{_TOPIC_CTES}
select person_id, pos, state from vp""", "topics_v")


# ---------------------------------------------------------------- state-model tables and scores
_GIBBS_DOCS = """
gd as (select job_id, person_id, pos, state as z, embedding as x,
              lag(state) over w as p, lead(state) over w as nx,
              list_sum(embedding) as len
       from topics_v window w as (partition by person_id order by pos))"""

add("gibbs_state_tables", f"""
with {_GIBBS_DOCS},
xs as (select z, unnest(x) as v, generate_subscripts(x, 1) - 1 as t from gd)
select 'start' as kind, z as i, 0 as j, round(cast(count(*) as double), 6) as value from gd where p is null group by z
union all
select 'trans', z, nx, round(cast(count(*) as double), 6) from gd where nx is not null group by z, nx
union all
select 'topic', z, cast(t as integer), round(sum(v), 6) from xs group by z, t
union all
select 'total', z, 0, round(sum(len), 6) from gd group by z""", "topics_v")

add("gibbs_init_totals", f"""
with {_GIBBS_DOCS},
xs as (select unnest(x) as v, generate_subscripts(x, 1) - 1 as t from gd)
select 'start' as kind, 0 as j, round(cast(count(distinct person_id) as double), 6) as value from gd
union all
select 'trans', 0, round(cast(count(*) - count(distinct person_id) as double), 6) from gd
union all
select 'topic', cast(t as integer), round(sum(v), 6) from xs group by t
union all
select 'total', 0, round(sum(len), 6) from gd""", "topics_v")

add("state_topic_loglik", f"""
with {_GIBBS_DOCS},
nt as (select max(len(x)) as t from gd),
xs as (select job_id, z, unnest(x) as v, generate_subscripts(x, 1) - 1 as t from gd),
c as (select z as s, t, sum(v) as c from xs group by z, t),
ct as (select z as s, sum(len) as ct from gd group by z),
st as (select distinct s from ct),
cand as (select gd.job_id, gd.z, gd.len, st.s from gd, st),
terms as (select cand.job_id, cand.s,
                 sum(case when xs.v > 0 then lgamma(c.c - case when cand.z = cand.s then xs.v else 0 end + 1 + xs.v)
                                            - lgamma(c.c - case when cand.z = cand.s then xs.v else 0 end + 1)
                          else 0 end) as tsum
          from cand join xs on xs.job_id = cand.job_id join c on c.s = cand.s and c.t = xs.t
          group by cand.job_id, cand.s)
select cand.job_id, cast(cand.s as integer) as state,
       round(terms.tsum + lgamma(ct.ct - case when cand.z = cand.s then cand.len else 0 end + nt.t)
             - lgamma(ct.ct - case when cand.z = cand.s then cand.len else 0 end + nt.t + cand.len), 4) as loglik
from cand join terms on terms.job_id = cand.job_id and terms.s = cand.s join ct on ct.s = cand.s, nt""",
    "topics_v")

add("state_seq_loglik", f"""
with {_GIBBS_DOCS},
ns as (select count(distinct person_id) as n from gd),
nst as (select max(z) + 1 as n from gd),
sts as (select unnest(range(0, (select n from nst))) as s),
st as (select z as a, count(*) as n from gd where p is null group by z),
tr as (select z as a, nx as b, count(*) as n from gd where nx is not null group by z, nx),
tt as (select z as a, count(*) as n from gd where nx is not null group by z),
cand as (select gd.*, sts.s from gd, sts),
v as (select cand.job_id, cand.s, cand.z, cand.p, cand.nx,
             coalesce(st.n, 0) - case when cand.p is null and cand.z = cand.s then 1 else 0 end as start_s,
             coalesce(tps.n, 0) - case when cand.p is not null and cand.p = cand.p and cand.s = cand.z then 1 else 0 end
                                - case when cand.nx is not null and cand.p = cand.z and cand.s = cand.nx then 1 else 0 end
               as trans_ps,
             coalesce(tsn.n, 0) - case when cand.p is not null and cand.s = cand.p and cand.nx = cand.z then 1 else 0 end
                                - case when cand.nx is not null and cand.s = cand.z then 1 else 0 end
               as trans_sn,
             coalesce(tt.n, 0) - case when cand.nx is not null and cand.s = cand.z then 1 else 0 end as tots_s
      from cand
      left join st on st.a = cand.s
      left join tr tps on tps.a = cand.p and tps.b = cand.s
      left join tr tsn on tsn.a = cand.s and tsn.b = cand.nx
      left join tt on tt.a = cand.s)
select job_id, cast(s as integer) as state, round(ln(
  case when p is null then
         (start_s + 1000.0) / ((select n from ns) - 1 + 1000.0 * (select n from nst))
         * case when nx is null then 1.0 else (trans_sn + 1.0) / (tots_s + 1.0 * (select n from nst)) end
       when nx is null then trans_ps + 1.0
       when p = z then (trans_ps + 1.0) * (trans_sn + case when z = nx then 1 else 0 end + 1.0)
                       / (tots_s + 1 + 1.0 * (select n from nst))
       else (trans_ps + 1.0) * (trans_sn + 1.0) / (tots_s + 1.0 * (select n from nst)) end), 4) as loglik
from v""", "topics_v")


# ---------------------------------------------------------------- separate keys for single functions
add("clean_title_loose", """
select person_id, pos, regexp_replace(lower(title), '[A-Z ]{6,}[A-Z ]{6,}', '', 'g') as clean
from titles_v""", "titles_v")

add("unconcat_state", f"select job_id, {_unconcat_sql('location')} as unconcat from locs_v", "locs_v")

add("strip_country", f"""
select job_id, case when ends_with(q, 'United States of America')
                    then substr(q, 1, strpos(q, 'United States of America') - 1) end as stripped
from (select job_id, {_preprocess_sql('location')} as q from locs_v) t""", "locs_v")

add("title_distinct", """
select count(distinct title) as n_titles, count(*) as n_jobs from titles_v""", "titles_v")

add("value_sample", """
select resume_id, salary from cust_v
order by md5(cast(resume_id as varchar) || '|7'), resume_id limit 100""", "cust_v")
