"""Oracle SQL (DuckDB) of the registered queries, over the same tables; white space is Unicode's, as in Spark."""

from __future__ import annotations

from fathom.operators import chunk as C

from . import registry as R

W = r"[\s\x0b\x85\p{Z}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x85\p{{Z}}]+|[\s\x0b\x85\p{{Z}}]+$', '', 'g')"


def _collapse(x: str) -> str:
    return _trim(f"regexp_replace({x}, '{W}', ' ', 'g')")


def _newlines(x: str) -> str:
    return rf"replace(replace(replace({x}, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _route(x: str) -> str:
    cases = " ".join(f"when len(list_filter({_list([w.lower() for w in words])}, lambda w: contains(lower({x}), w))) > 0 then {_q(name)}" for name, words in R.ROUTES)
    return f"case {cases} else {_q(R.DEFAULT_ROUTE)} end"


def _terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[\s\x0b\x85\p{{Z}},，;；]+'), lambda t: t <> '')"


def _lines(table: str, key: str) -> str:
    """CTE body: (key, pos, line) of the cleaned lines."""
    return rf"""select {key}, row_number() over (partition by {key} order by i) as pos, line from (
        select {key}, i, {_collapse("l")} as line from (
            select {key}, unnest(string_split({_newlines("text")}, chr(10))) as l, generate_subscripts(string_split({_newlines("text")}, chr(10)), 1) as i from {table} where text is not null))
        where line <> '' and not regexp_matches(line, '^[-=_ ]+$')"""


def _uniq(source: str, key: str, value: str) -> str:
    """(key, pos, value): canonical values, first occurrences, from rows (key, i, v)."""
    return f"""select {key}, row_number() over (partition by {key} order by i) as pos, v as {value} from (
        select {key}, v, min(i) as i from (select {key}, i, {_collapse("v")} as v from ({source})) where v <> '' group by 1, 2)"""


_WINDOWS = rf"""w as (select doc_id, product_id, k, {_trim("substring(body, k * 520 + 1, 600)")} as c from (
    select doc_id, product_id, body, unnest(range(0, greatest(ceil((length(body) - 80) / 520.0)::bigint, case when length(body) > 0 then 1 else 0 end))) as k
    from (select doc_id, product_id, {_newlines("text")} as body from documents where text is not null)))"""

_EVIDENCE = """'- 来源文件：' || coalesce(nullif(m['source_file'], ''), 'unknown') || '｜段落：' || coalesce(nullif(m['chunk_id'], ''), '?') || '｜类型：' || coalesce(nullif(m['source_type'], ''), 'unknown')"""
_STEPS = rf"""l as ({_lines("docs", "ord")}),
    m as (select ord, pos, line, case when contains(line, '注意') or contains(line, 'Notes') or contains(line, 'Hinweis') then 0
        when regexp_matches(translate(line, '０１２３４５６７８９', '0123456789'), '^(?i)STEP[\s\p{{Z}}]*[0-9]+') then (
            select case when n between 1 and 5 then n else -1 end from (select try_cast(regexp_extract(translate(line, '０１２３４５６７８９', '0123456789'), '^(?i)STEP[\s\p{{Z}}]*([0-9]+)', 1) as bigint) as n)) end as mark from l),
    f as (select *, last_value(mark ignore nulls) over (partition by ord order by pos) as s from m),
    r as (select ord, pos, case when s >= 0 then s end as bucket, {_trim("ltrim(line, '-')")} as line from f where mark is null)"""
_SECTION = f"""select doc_id, case when start is null then '' else {_trim("case when stop is null then rest else substring(rest, 1, stop - 1) end")} end as s from (
    select *, list_min(list_filter(list_transform({_list(R.STOPS)}, lambda x: strpos(rest, x)), lambda p: p > 1)) as stop from (
        select doc_id, start, substring(body, start) as rest from (
            select doc_id, body, list_min(list_filter(list_transform({_list(R.TITLES)}, lambda x: strpos(body, x)), lambda p: p > 0)) as start
            from (select doc_id, coalesce({_newlines("text")}, '') as body from documents))))"""
_TITLE = "case route " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in R.CASE_ROUTES.items()) + " end"
_UNIT = "list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))"
_VECTOR = """s as (select q.vec_id as qid, c.vec_id as id, list_inner_product(q.u, c.u) as score from e q join e c on q.vec_id % 20 = 0 {more})"""
_PROJECTS = ", ".join(f"({_q(p)}, {_list(a)})" for p, a in R.PROJECTS)
_SPLIT = "|".join(R.SEPARATORS)

ORACLE: dict[str, str] = {
    "l2_normalize": """with v as (select vec_id, embedding::double[] as e from embeddings)
        select vec_id, round(sqrt(list_inner_product(e, e)), 6) as norm, 1.0::double as unit, round(e[1] / sqrt(list_inner_product(e, e)), 6) as first from v""",
    "vector_topk": f"""with v as (select vec_id, embedding::double[] as e from embeddings), e as (select vec_id, {_UNIT} as u from v), {_VECTOR.format(more="")}
        select qid, id, round(score, 6) as score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 12""",
    "keyword_score": f"""with t as (select qa_id, {_terms("rewritten_query")} as t, lower(coalesce(answer, '')) as low from qa_log)
        select qa_id, case when len(t) > 0 then round(len(list_filter(t, lambda w: contains(low, w))) / len(t)::double, 6) else 0.0 end as score from t""",
    "keyword_topk": f"""with q as (select case_id as qid, {_terms("concat_ws(' ', q, array_to_string(expect_any, ' '))")} as t from regression_cases where case_id % 20 = 0),
        s as (select qid, doc_id as id, len(list_filter(t, lambda w: contains(lower(coalesce(text, '')), w))) / len(t)::double as score from q cross join documents where len(t) > 0)
        select qid, id, round(score, 6) as score, row_number() over (partition by qid order by score desc, id) as rank from s where score > 0 qualify rank <= 12""",
    "hybrid_topk": f"""with v as (select vec_id, embedding::double[] as e from embeddings), u as (select vec_id, {_UNIT} as u from v),
        c as (select doc_id, u from documents join u on doc_id = vec_id),
        a as (select qa_id, u, {_terms("rewritten_query")} as t from qa_log join u on qa_id = vec_id where qa_id % 20 = 0),
        s as (select qa_id as qid, doc_id as id, list_inner_product(a.u, c.u) as score from a cross join c),
        v0 as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 12),
        k1 as (select qa_id as qid, doc_id as id, len(list_filter(t, lambda w: contains(lower(coalesce(text, '')), w))) / len(t)::double as score from a cross join documents where len(t) > 0),
        k0 as (select *, row_number() over (partition by qid order by score desc, id) as rank from k1 where score > 0 qualify rank <= 12),
        v2 as (select qid, text, max_by(score, rank) as vs, max_by(id, rank) as vid, min(rank) as vp from v0 join documents on doc_id = id where text is not null group by 1, 2),
        k as (select qid, text, list_sum(list(score order by rank)) as ks, min_by(id, rank) as kid, min(rank) as kp from k0 join documents on doc_id = id where text is not null group by 1, 2),
        m as (select coalesce(v2.qid, k.qid) as qid, coalesce(vid, kid) as id, coalesce(vs, 0.0) as vs, coalesce(ks, 0.0) as ks, coalesce(vs, 0.0) * 0.65::double + coalesce(ks, 0.0) * 0.35::double as hs, vp is null as late, coalesce(vp, kp) as place
            from v2 full outer join k on v2.qid = k.qid and v2.text = k.text)
        select qid, id, round(vs, 6) as vector_score, round(ks, 6) as keyword_score, round(hs, 6) as hybrid_score, row_number() over (partition by qid order by hs desc, late, place) as rank from m qualify rank <= 8""",
    "chunk_fixed": f"with {_WINDOWS} select doc_id, row_number() over (partition by doc_id order by k) as chunk_id, length(c)::bigint as n, md5(c) as digest from w where c <> ''",
    "chunk_counts": f"""with {_WINDOWS}, n as (select doc_id, count(*) as n from w where c <> '' group by 1)
        select coalesce(product_id, '') as product_id, sum(coalesce(n, 0))::bigint as chunks, count(*) as files from documents left join n using (doc_id) group by 1""",
    "chunk_packed": rf"""with b as (select doc_id, {_trim("regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as body from documents where text is not null),
        l as (select doc_id, list_transform(string_split(body, chr(10)), lambda x: {_trim("x")}) as l from b),
        m as (select doc_id, array_to_string(list_transform(l, lambda x: case when x = '' then chr(30) when regexp_matches(x, '(?i){"|".join(C.TITLES)}') then chr(30) || x || chr(30) else x end), chr(10)) as m from l),
        p as (select doc_id, list_filter(regexp_split_to_array(m, '\n?(?:\x1e\n?)+'), lambda x: x <> '') as p from m),
        f as (select doc_id, list_reduce(list_transform(p, lambda x: struct_pack(chunks := []::varchar[], open := x)), lambda a, x:
            case when length(x.open) > 504 then struct_pack(chunks := a.chunks || list_filter([{_trim("a.open")}], lambda c: c <> '') || list_filter(list_transform(range(0, (length(x.open) - 1) // 320 + 1), lambda i: {_trim("substring(x.open, (i * 320 + 1)::int, 420)")}), lambda c: c <> ''), open := '')
                when length(case when a.open = '' then x.open else a.open || chr(10) || x.open end) <= 420 then struct_pack(chunks := a.chunks, open := case when a.open = '' then x.open else a.open || chr(10) || x.open end)
                else struct_pack(chunks := a.chunks || list_filter([{_trim("a.open")}], lambda c: c <> ''), open := case when len(a.chunks) = 0 and a.open = '' then x.open
                    when length({_trim("right(case when a.open = '' then a.chunks[-1] else " + _trim("a.open") + " end, 100) || chr(10) || x.open")}) > 546 then x.open
                    else {_trim("right(case when a.open = '' then a.chunks[-1] else " + _trim("a.open") + " end, 100) || chr(10) || x.open")} end) end,
            struct_pack(chunks := []::varchar[], open := '')) as s from p),
        c as (select doc_id, s.chunks || list_filter([{_trim("s.open")}], lambda c: c <> '') as c from f),
        u as (select doc_id, unnest(c) as text, generate_subscripts(c, 1) as i from c),
        k as (select doc_id, text, i, {_collapse("text")} as k from u qualify row_number() over (partition by doc_id, {_collapse("text")} order by i) = 1)
        select doc_id, row_number() over (partition by doc_id order by i) as chunk_id, text from k""",
    "normalize_lines": _lines("documents", "doc_id"),
    "unique_lines": _uniq(f"select doc_id, unnest(string_split({_newlines('text')}, chr(10))) as v, generate_subscripts(string_split({_newlines('text')}, chr(10)), 1) as i from documents where text is not null", "doc_id", "line"),
    "section_block": f"with s as ({_SECTION}) select doc_id, length(s)::bigint as n, md5(s) as digest from s",
    "detect_terms": """with a as (select distinct product_id, lower(alias) as alias from product_aliases where alias is not null and product_id is not null),
        h as (select distinct qa_id, product_id from qa_log join a on contains(lower(question), alias))
        select q.qa_id, coalesce(string_agg(product_id, ',' order by product_id), '') as products from qa_log q left join h using (qa_id) group by 1""",
    "resolved_products": f"""with a as (select distinct product_id, lower(alias) as alias from product_aliases where alias is not null and product_id is not null),
        h as (select qa_id, min(product_id) as p from qa_log join a on contains(lower(question), alias) group by 1),
        d as (select case when count(*) filter (meta.product_id = {_q(R.DEFAULT_PRODUCT)}) > 0 then {_q(R.DEFAULT_PRODUCT)} else min(meta.product_id) end as p from docs)
        select qa_log.qa_id, coalesce(h.p, d.p) as product_id from qa_log left join h using (qa_id), d""",
    "strong_score": f"""with t as (select qa_id, {_terms("rewritten_query")} as t, lower(coalesce(rewritten_query, '')) as q, lower(coalesce(answer, '')) as low from qa_log)
        select qa_id, round(case when len(t) > 0 then len(list_filter(t, lambda w: contains(low, w))) / len(t)::double else 0.0 end
            + len(list_filter({_list([w.lower() for w in R.WORDS])}, lambda w: contains(q, w) and contains(low, w))) * {R.BOOST}::double, 6) as score from t""",
    "ambiguous_questions": """with a as (select distinct product_id, lower(alias) as alias from product_aliases where alias is not null and product_id is not null)
        select qa_id, count(distinct product_id) as n from qa_log join a on contains(lower(question), alias) group by 1 having count(distinct product_id) > 1""",
    "detect_route": f"select qa_id, {_route('question')} as route from qa_log",
    "route_counts": f"""with r as (select {_route("question")} as route, hit, case when latency_ms >= 0 then latency_ms end as l from qa_log)
        select route, count(*) as n, count(*) filter (not coalesce(hit, false)) as misses, round(avg(l), 4) as latency, max(l)::bigint as slowest from r group by 1""",
    "split_questions": _uniq(f"select qa_id, unnest(regexp_split_to_array(question, '{_SPLIT}')) as v, generate_subscripts(regexp_split_to_array(question, '{_SPLIT}'), 1) as i from qa_log where question is not null", "qa_id", "part"),
    "rewrite_expand": f"""with a as (select product_id, list(alias order by alias_ord, alias)[1:4] as aliases from product_aliases group by 1),
        p as (select qa_id, list_concat([coalesce(question, '')], list_concat(coalesce(aliases, []), list_filter({_list(R.WORDS)}, lambda w: contains(coalesce(question, ''), w)))) as l
            from qa_log left join a on a.product_id = qa_log.meta['product_id']),
        u as ({_uniq("select qa_id, unnest(l) as v, generate_subscripts(l, 1) as i from p", "qa_id", "part")})
        select qa_id, coalesce(string_agg(part, ' ' order by pos), '') as expanded from qa_log left join u using (qa_id) group by 1""",
    "rewrite_struct": f"""with q as (select qa_id, {_trim("coalesce(question, '')")} as q from qa_log),
        pa as (select product_id, list(alias order by alias_ord, alias)[1:4] as a from product_aliases where alias is not null and product_id is not null group by 1),
        ph as (select distinct qa_id, product_id from q join product_aliases p on p.alias is not null and p.product_id is not null and contains(lower(q), lower(alias))),
        ja(project_id, a) as (values {_PROJECTS}),
        jh as (select distinct qa_id, project_id from q, (select project_id, unnest(a) as alias from ja) where contains(lower(q), lower(alias))),
        w as (select qa_id, 0 as i, q as v from q
            union all select qa_id, 1000 + 10 * dense_rank() over (order by product_id) + n, v from (select qa_id, product_id, unnest(a) as v, generate_subscripts(a, 1) as n from ph join pa using (product_id))
            union all select qa_id, 1000000 + 10 * dense_rank() over (order by project_id) + n, v from (select qa_id, project_id, unnest(a[1:3]) as v, generate_subscripts(a[1:3], 1) as n from jh join ja using (project_id))
            union all select qa_id, 2000000 + n, v from (select qa_id, q, unnest({_list(R.TIMES)}) as v, unnest(range(1, {len(R.TIMES) + 1})) as n from q) where contains(q, v)
            union all select qa_id, 3000000 + n, v from (select qa_id, q, unnest({_list(R.WORDS)}) as v, unnest(range(1, {len(R.WORDS) + 1})) as n from q) where contains(q, v)),
        u as ({_uniq("select qa_id, i, v from w", "qa_id", "part")}),
        s as ({_uniq(f"select qa_id, unnest(regexp_split_to_array(q, '{_SPLIT}')) as v, generate_subscripts(regexp_split_to_array(q, '{_SPLIT}'), 1) as i from q", "qa_id", "part")})
        select q.qa_id, q as original, coalesce((select string_agg(part, ' ' order by pos) from u where u.qa_id = q.qa_id), '') as expanded,
            coalesce((select string_agg(product_id, ',' order by product_id) from ph where ph.qa_id = q.qa_id), '') as products, coalesce((select string_agg(project_id, ',' order by project_id) from jh where jh.qa_id = q.qa_id), '') as projects,
            array_to_string(list_filter({_list(R.TIMES)}, lambda t: contains(q, t)), ',') as times, array_to_string(list_filter({_list(R.WORDS)}, lambda t: contains(q, t)), ',') as symptoms,
            (select count(*) from s where s.qa_id = q.qa_id) as parts from q""",
    "bullets": f"""with x as ({_SECTION}), y as (select doc_id, s as text from x), l as ({_lines("y", "doc_id")}),
        c as (select doc_id, pos as i, {_trim("ltrim(line, '-')")} as v from l where not starts_with(line, '【Q】') and not starts_with(line, '【A】')),
        k as (select * from c where v <> '' and (regexp_matches(v, '^[0-9]+[）)]') or length(v) <= 60 or len(list_filter({_list(R.WORDS)}, lambda w: contains(v, w))) > 0)),
        u as ({_uniq("select doc_id, i, v from k", "doc_id", "line")})
        select doc_id, string_agg(line, chr(10) order by pos) as lines from u where pos <= 12 group by 1""",
    "embed_texts": r"""with t as (select ord, """ + _collapse("lower(coalesce(text, ''))") + r""" as s from docs),
        p as (select ord, s, unnest(range(1, greatest(length(s) - 1, 1))) as i from t),
        g as (select ord, ((((unicode(s[i])::uhugeint * 11400714819323198485::uhugeint + unicode(s[i + 1])::uhugeint) % 18446744073709551616::uhugeint) * 11400714819323198485::uhugeint + unicode(s[i + 2])::uhugeint) % 18446744073709551616::uhugeint)::ubigint as h from p),
        x as (select ord, xor(h, h >> 31) as h from g),
        c as (select ord, (h % 64)::int as cell, sum(case when (h >> 40) & 1 = 1 then 1 else -1 end)::double as v from x group by 1, 2),
        n as (select ord, sqrt(sum(v * v)) as n, sum(v * (cell + 1)) as w, max(v) as m, count(*) as cells from c group by 1)
        select docs.ord, case when n > 0 then 1.0 else 0.0 end::double as unit, coalesce(round(case when n > 0 then w / n else 0 end, 6), 0.0) as digest,
            coalesce(round(case when n > 0 then greatest(m, case when cells < 64 then 0 else m end) / n else 0 end, 6), 0.0) as largest from docs left join n using (ord)""",
    "media_route": """with m as (select *, row_number() over (order by title) as ord from media_items),
        h as (select distinct qa_id, ord, title, media_type, coalesce(url, '') as url from qa_log, m where len(list_filter(keywords, lambda w: contains(lower(question), lower(w)))) > 0)
        select qa_id, ord as media_order, title, media_type, url from h qualify row_number() over (partition by qa_id order by ord) <= 6""",
    "state_fill": f"with l as ({_lines('documents', 'doc_id')}) select doc_id, pos, last_value(case when regexp_matches(line, {_q(R.MARKERS)}) then line end ignore nulls) over (partition by doc_id order by pos) as state from l",
    "step_lines": f"with {_STEPS} select ord, pos, bucket, line from r where line <> ''",
    "step_answer": f"""with {_STEPS}, b as (select ord, bucket, pos as i, line as v from r where line <> '' and bucket is not null),
        u as (select ord, bucket, v, min(i) as i from (select ord, bucket, i, {_collapse("v")} as v from b) where v <> '' group by 1, 2, 3),
        k as (select *, row_number() over (partition by ord, bucket order by i) as n from u)
        select ord, bucket, string_agg(v, chr(10) order by n) as lines from k where n <= case when bucket in (0, 4) then 2 else 1 end group by 1, 2""",
    "unified_chunks": r"""select ord, coalesce(id, coalesce(meta.product_id, 'unknown') || '/' || coalesce(string_split(meta.source_file, '/')[-1], 'unknown') || '::chunk_' || coalesce((meta.chunk_id - 1)::varchar, '?')) as chunk_key,
        coalesce(meta.chunk_id, try_cast(nullif(regexp_extract(id, '::chunk_(\d+)$', 1), '') as int) + 1)::bigint as chunk_id, string_split(meta.source_file, '/')[-1] as source_file, coalesce(length(text), 0)::bigint as n from docs""",
    "latest_chunks": """with c as (select ord, built_at, coalesce(id, coalesce(meta.product_id, 'unknown') || '/' || coalesce(string_split(meta.source_file, '/')[-1], 'unknown') || '::chunk_' || coalesce((meta.chunk_id - 1)::varchar, '?')) as chunk_key from docs)
        select chunk_key, arg_max(ord, (built_at, ord)) as ord, count(*) as versions from c group by 1""",
    "evidence": f"select qa_id, array_to_string(list_transform(matched_sources[1:6], lambda m: {_EVIDENCE}), chr(10)) as evidence from qa_log where len(matched_sources) > 0",
    "answer_format": f"""with r as (select *, {_route("question")} as route from qa_log)
        select qa_id, concat_ws(chr(10), {_TITLE} || '（资料提取）：', '结论：', '- ' || coalesce(rewritten_query, ''),
            case when len(matched_sources) > 0 then '依据：' || chr(10) || array_to_string(list_transform(matched_sources[1:6], lambda m: {_EVIDENCE}), chr(10)) end,
            '注意事项：', '- ' || {_q(R.NOTE)}, case when route = 'risk' then '需医生评估项：' || chr(10) || '- 请先咨询医生。' end) as answer from r""",
    "recent_qa": "select qa_id, ts, coalesce(question, '') as question from qa_log order by ingested_at desc nulls last, qa_id desc limit 20",
    "recent_errors": "select ts, stage, coalesce(error, '') as error from error_log order by ts desc nulls last, stage desc nulls last, error desc limit 20",
    "error_stages": "select stage, count(*) as n, count(distinct coalesce(error, '')) as errors, max(ts) as last from error_log group by 1",
    "miss_log": "select ts, coalesce(question, '') as question, coalesce(rewritten_query, '') as rewritten_query, coalesce(meta['product_id'], '') as product_id from qa_log where hit = false",
    "resent_rows": "select min(qa_id) as qa_id, count(*) as copies from qa_log group by ts, question, answer having count(*) > 1",
    "late_rows": "select substr(ts, 1, 10) as day, count(*) as n, count(*) filter (ingested_at > ts::timestamp + interval 1 hour) as late from qa_log where ingested_at is not null and ts is not null group by 1",
    "shared_aliases": "select alias, count(distinct product_id) as products, min(product_id) as first from product_aliases group by 1 having count(distinct product_id) > 1",
    "catalog": "select coalesce(source, '') as source, coalesce(string_agg(distinct lang, ',' order by lang), '') as langs, count(*) as n from documents group by 1",
    "regression_pass": "select lang, count(*) as n, count(*) filter (len(list_filter(expect_any, lambda w: contains(coalesce(reference, ''), w))) > 0) as passed from regression_cases group by 1",
    "regression_answers": f"""with q as (select {_collapse("lower(question)")} as k, answer from qa_log where question is not null and answer is not null)
        select case_id, count(answer) as answers, count(*) filter (answer is not null and len(list_filter(expect_any, lambda w: contains(answer, w))) > 0) as passed
        from (select case_id, {_collapse("lower(q)")} as k, expect_any from regression_cases) c left join q on c.k = q.k group by 1""",
}
