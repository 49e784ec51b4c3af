"""The same results in DuckDB's SQL, where it can express them."""

from __future__ import annotations

from maskwerk.llm import archives, fingerprints, lexical, licenses, secrets
from maskwerk.llm.quality import CLASSES, COMMON, GUARD_WORDS, MOST_CLASSES, MOST_COMMON, NOISE


def _secret_spans() -> str:
    """An SQL list of spans (s, k, e) for each kind, concatenated."""
    parts = []
    for k, (pattern, group, least) in enumerate(secrets.RULES.values()):
        p = pattern.replace("'", "''")
        gaps, hits = f"list_transform(regexp_split_to_array(t, '{p}'), lambda x: len(x))", f"list_transform(regexp_extract_all(t, '{p}'), lambda x: len(x))"
        told = f"list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: len(x))"
        start = "coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(h[1:i - 1]), 0)"
        parts.append(f"""(select list({{'s': ({start})::int, 'k': {k}, 'e': ({start} + h[i])::int}}) from (select g, h, unnest(range(1, len(h) + 1)) as i, d from (select {gaps} as g, {hits} as h, {told} as d)) where d[i] >= {least})""")
    return "list_concat(" + ", ".join(f"coalesce({p}, [])" for p in parts) + ")"


def _secrets() -> str:
    names = "[" + ", ".join(f"'{k}'" for k in secrets.RULES) + "]"
    listed = f"coalesce(list_aggregate(list_transform({{}}, lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), 'string_agg', ','), '')"
    counts = ", ".join(f"len(list_filter(found, lambda x: x.k = {k}))::bigint as n_{n}" for k, n in enumerate(secrets.BASE))
    base = f"list_filter(found, lambda x: x.k < {len(secrets.BASE)})"
    return f"""select doc_id, {counts}, sha256({listed.format(base)}) as base_sha256, {listed.format('found')} as spans
from (select doc_id, list_sort({_secret_spans()}) as found from (select doc_id, coalesce(text, '') as t from documents))"""


def _quality() -> str:
    """Base rules by unnested windows; divergence by sums over the languages."""
    classes = ", ".join(f"len(t) - len(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in CLASSES.values())
    lists = "case lang " + " ".join(f"when '{k}' then [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items()) + " end"
    def distance(counts: str, shares: str, n: int) -> str:
        c, q = f"{counts}[i]::double / list_sum({counts})", f"{shares}[i]"
        half = f"(({c} + {q}) / 2)"
        part = lambda x: f"case when {x} > 0 then {x} * log2({x} / {half}) else 0.0 end"
        return f"sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: ({part(c)}) + ({part(q)}))) / 2, 0.0))"

    n = len(CLASSES) + 2
    return f"""with base as (select doc_id, case when lang in ({', '.join(repr(k) for k in COMMON)}) then lang end as lang, coalesce(text, '') as t from documents),
words as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from base),
counts as (select *, len(w)::bigint as n, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as letters, {lists} as common,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, [{classes}] as cl from words),
hist as (select *, list_concat(cl, [len(t) - letters, letters - list_sum(cl)]) as classes,
    case when lang is not null then list_concat(list_transform(common, lambda x: len(list_filter(w, lambda y: y = x))), [n - list_sum(list_transform(common, lambda x: len(list_filter(w, lambda y: y = x))))]) end as freq from counts),
refs as (select lang, list_transform(c, lambda x: x / greatest(list_sum(c), 1)) as rc, list_transform(f, lambda x: x / greatest(list_sum(f), 1)) as rf from (
    select lang, [{', '.join(f'sum(classes[{i + 1}])::double' for i in range(n))}] as c, [{', '.join(f'sum(freq[{i + 1}])::double' for i in range(13))}] as f from hist where lang is not null group by lang)),
windows as (select doc_id, i, w[i:i + 7] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) as i from words)),
twice as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as k from windows) where k > 1),
repeated as (select doc_id, sum(least(8, i - coalesce(p, i - 8)))::bigint as r from twice group by doc_id),
judged as (select h.*, coalesce(r, 0) as r, n < 20 or 100 * coalesce(r, 0) > 30 * n as failed, case when rc is not null and n > 0 then {distance('classes', 'rc', n)} end as dc, case when rc is not null and n > 0 then {distance('freq', 'rf', 13)} end as df
    from hist h left join repeated using (doc_id) left join refs on refs.lang = h.lang)
select doc_id, n as n_words, letters as word_chars, cl[{list(CLASSES).index('symbol') + 1}]::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, r as n_repeat_words, failed as base_failed,
    not failed and not coalesce(n >= {GUARD_WORDS} and (dc > {MOST_CLASSES} or df > {MOST_COMMON} + {NOISE} / sqrt(n)), false) as kept from judged"""


SUFFIXES = """with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select doc_id, i, h[2 * i + 1:2 * i + 100] as w from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as i from bytes)),
later as (select doc_id, i, i + 50 as e from (select doc_id, i, min(doc_id) over (partition by w) as first_doc from windows) where first_doc < doc_id),
runs as (select doc_id, min(i) as s, max(e) as e from (select *, sum(new) over (partition by doc_id order by i) as run from (
    select *, case when i <= lag(e) over (partition by doc_id order by i) then 0 else 1 end as new from later)) group by doc_id, run),
gaps as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before, lead(s) over (partition by doc_id order by s) is null as is_last from runs),
kept as (select doc_id, count(*) as n_spans, sum(e - s) as n_removed, string_agg(b.h[2 * before + 1:2 * s], '' order by s) || max(case when is_last then b.h[2 * e + 1:] else '' end) as k from gaps join bytes b using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from bytes left join kept using (doc_id)"""

NGRAMS = """with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from words),
tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (select a.doc_id as a, b.doc_id as b from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as d, doc_id as r from sets union select reach.d, edges.b from reach join edges on edges.a = reach.r)
select doc_id, len(s)::bigint as n_shingles, m as component_id from sets join (select d, min(r) as m from reach group by d) on d = doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scans": _secrets(),
        "op4_fingerprints": fingerprints.ORACLE_SQL,
        "op5_license_scans": licenses.oracle_sql(),
        "op8_quality_rules": _quality(),
        "op9_suffix_dedup": SUFFIXES,
        "op10_ngram_join": NGRAMS,
        "op11_warc": archives.ORACLE_SQL,
        "op13_lexical_search": lexical.ORACLE_SQL,
    }
