"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from .functions.features import WIDTHS
from .queries import DICTIONARY, ELEMENTS, GAPS, LITERALS, PRODUCTS, VOCABULARY, WIDTH

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURED = """
m as (
    select event_id, nullif(trim(case when event_id % 13 <> 0 then user_id::varchar end), '') as std_user, event_type as std_type,
           case when event_id % 5 <> 0 then value::double end as v, case when event_id % 3 <> 0 then props end as props
    from events),
k as (select * from m where std_user is not null and std_type is not null)"""

_cells = [
    *[f"case when true{f' and vec_id % 11 <> {i}' if i < 6 else ''}{' and vec_id % 17 <> 0' if i < GAPS else ''} then embedding[{i + 1}]::double end" for i in range(ELEMENTS)],
    "case when vec_id % 5 <> 0 then embedding[1]::double * 2 end",
    "-(embedding[2]::double)",
    "(embedding[3] > 0)::int::double",
    "(vec_id % 200 = 0)::int::double",
]
MATRIX = f"""
f as (select vec_id, [{', '.join(_cells)}] as f from embeddings),
l as (select vec_id, unnest(range({WIDTH}))::int as pos, unnest(f) as v from f),
r as (select vec_id, count(*) filter (where v is null) / {WIDTH}.0::double as missing_ratio from l group by vec_id having missing_ratio <= 0.3),
kl as (select l.* from l join r on l.vec_id = r.vec_id),
s as (select pos, count(*) as n_rows, count(*) filter (where v is null) as n_missing, count(*) filter (where v is null) / count(*)::double as missing_ratio,
             count(*) filter (where v not in (0, 1)) = 0 as is_binary, var_samp(v) as variance from kl group by pos)"""

PAIRS = """
p as (select a.pos as i, b.pos as j, a.v as x, b.v as y from kl a join kl b on a.vec_id = b.vec_id and a.pos < b.pos where a.v is not null and b.v is not null)"""
RANKED = """
rk as (
    select i, j, rank() over (partition by i, j order by x) + (count(*) over (partition by i, j, x) - 1) / 2.0::double as x,
           rank() over (partition by i, j order by y) + (count(*) over (partition by i, j, y) - 1) / 2.0::double as y
    from p),
sp as (select i, j, count(*) as n, corr(x, y) as corr from rk group by i, j)"""


def _losers(t: str = "sp", among: str = "true") -> str:
    return f"""
lo as (
    select distinct case when b.n_missing > a.n_missing then b.pos else a.pos end as pos
    from {t} join s a on {t}.i = a.pos join s b on {t}.j = b.pos where abs(corr) >= 0.9 and {among})"""


WORDS = r"'[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]'"
PARTS = rf"""
t as (select p_partkey, regexp_extract_all(concat_ws(' ', p_name, p_brand, p_type, p_size::varchar), {WORDS}) as t from part)"""
DOCS = rf"""
t as (select doc_id, text, regexp_extract_all(text, {WORDS}) as t from documents where len(regexp_extract_all(text, {WORDS})) > 0)"""


def _bucket(key: str, n: int) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::bigint % {n}"


def _ngrams(n: int) -> str:
    return f"list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n} - 1], ' '))"


def _keys(lists: list[str], id_col: str = "p_partkey") -> str:
    return " union all ".join(f"select {id_col}, unnest({x}) as key from t" for x in lists)


_paths = [_ngrams(n) for n in range(1, 8)]
_near = [f"list_transform(range(1, len(t) + 1), lambda i: '{r}: ' || array_to_string(t[greatest(i - {r}, 1):least(i + {r}, len(t))], ' '))" for r in range(3)]
_pair = [f"list_transform(range(1, len(t) - {d} + 1), lambda i: t[i] || '|' || t[i + {d}] || '|{d}')" for d in range(1, 6)]


def _bits(lists: list[str]) -> str:
    return f"""
        with {PARTS}, k as ({_keys(lists)}), b as (select distinct p_partkey, {_bucket('key', 2048)} as b from k)
        select p_partkey, string_agg(b::varchar, ',' order by b) as bits from b group by p_partkey"""


PREDICTED = """
p as (
    select l_returnflag as model, l_linestatus || (l_linenumber % 4)::varchar as feature_set, ascii(l_returnflag) * 10 + l_linenumber % 4 as seq,
           (l_quantity > 25)::int as y, round(((l_orderkey * 31 + l_linenumber * 17 + l_quantity::bigint * 3) % 101) / 100.0::double, 2) as prob
    from lineitem),
pr as (select *, (prob > 0.5)::int as pred from p)"""


def _metrics(by: str) -> str:
    return f"""
c as (
    select {by}, count(*) filter (where y = 1 and pred = 1)::double as tp, count(*) filter (where y = 0 and pred = 0)::double as tn,
           count(*) filter (where y = 0 and pred = 1)::double as fp, count(*) filter (where y = 1 and pred = 0)::double as fn
    from pr group by {by}),
d as (select {by}, prob, count(*) filter (where y = 1)::double as pos, count(*) filter (where y = 0)::double as neg from pr group by {by}, prob),
w as (select *, coalesce(sum(neg) over (partition by {by} order by prob rows between unbounded preceding and 1 preceding), 0) as below from d),
auc as (select {by}, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) as roc_auc from w group by {by}),
g as (
    select c.*, auc.roc_auc, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as "precision",
           coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(tn / nullif(tn + fp, 0), 0) as specificity, coalesce(tn / nullif(tn + fn, 0), 0) as npv,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
           coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) as mcc
    from c join auc using ({by}))"""


RATES = ", ".join(f'round({c}, 6) as {c}' for c in ("accuracy", '"precision"', "recall", "specificity", "npv", "f1", "mcc", "roc_auc"))
GRID = f"{PREDICTED}, {_metrics('model, feature_set, seq')}"

SCORED = """
sc as (select event_id as id, ((event_id * 37) % 101) / 100.0::double as prob from events),
cf as (select *, case when prob >= 0.9 then 1 when prob <= 0.1 then 0 end as pseudo_label from sc)"""
QUOTA = f"""{SCORED},
n as (select count(*) filter (where pseudo_label = 1) as p, count(*) filter (where pseudo_label = 0) as n from cf),
t as (select count(*) filter (where quality = 1) as pos, count(*) filter (where quality = 0) as neg from labels),
q0 as (
    select p, n, case when pos < neg then least(p, neg - pos) else least(p, least(n, pos - neg)) end as a,
           case when pos < neg then least(n, least(p, neg - pos)) else least(n, pos - neg) end as b from n, t),
q as (select least(p, greatest(a, 10)) as take_pos, least(n, greatest(b, 10)) as take_neg from q0)"""


def _cap(cap: int) -> str:
    h = cap // 2
    return f"""
h as (select take_pos as p, take_neg as n, least(take_pos, {h}) as a, least(take_neg, {cap} - least(take_pos, {h})) as b from q),
cq as (
    select case when p + n <= {cap} then p when b < {h} then least(p, {cap} - b) else a end as take_pos,
           case when p + n <= {cap} then n else b end as take_neg from h)"""


def _picked(quota: str) -> str:
    return f"""
pk as (select *, row_number() over (partition by pseudo_label order by md5('42|' || id::varchar), id) as rn from cf where pseudo_label is not null)
select id, pseudo_label::int as pseudo_label, prob, 1::int as iteration from pk, {quota} where rn <= case when pseudo_label = 1 then take_pos else take_neg end"""


SELECTED = f"""{SCORED},
se as (
    select *, (id % 3 + 1)::int as iteration, case when pseudo_label = 1 then prob else 1 - prob end as c from cf where pseudo_label is not null),
sq as (
    select iteration, count(*) as n_selected, count(*) filter (where pseudo_label = 1) as n_positive, count(*) filter (where pseudo_label = 0) as n_negative,
           avg(c) as mean_c, stddev_pop(c) as std_c, min(c) as min_c, max(c) as max_c
    from se group by iteration)"""

FEATURES = """
d as (select doc_id as id, n_chars::double as a, length(source)::double as b, ascii(lang)::double as c from documents),
tr as (select d.*, quality as y from d join labels on id = doc_id),
po as (select * from d where id not in (select doc_id from labels))"""
NEAR = f"""{FEATURES},
x as (select po.id as qid, tr.id as tid, y, (po.a - tr.a) ** 2 + (po.b - tr.b) ** 2 + (po.c - tr.c) ** 2 as d2 from po, tr),
nn as (select *, row_number() over (partition by qid order by d2, tid) as rank from x)"""

VECTORS = """
e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as f, label % 2 as y from embeddings),
po as (select id, f from e where id % 4 <> 0)"""
D2 = "list_sum(list_transform(list_zip(po.f, tr.f), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def oracle_sql() -> dict[str, str]:
    descriptors = """
        select doc_id, length(text)::double as n_chars, len(t)::double as n_tokens, len(list_distinct(t))::double as n_distinct,
               round(len(list_distinct(t)) / len(t)::double, 6) as distinct_ratio, round(list_sum(list_transform(t, lambda x: length(x))) / len(t)::double, 6) as mean_length,
               list_max(list_transform(t, lambda x: length(x)))::double as max_length,
               len(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+')))::double as n_numbers
        from t"""
    literals = ", ".join(f"case when contains(t, '{w}') then '{i}' end" for i, w in enumerate(LITERALS))
    keys = ", ".join(f"regexp_matches(text, '{p}')::int::varchar" for p in DICTIONARY)
    counts = ", ".join(f"len(list_filter(t, lambda x: lower(x) = '{w}'))::varchar" for w in VOCABULARY)
    sizes = ", ".join(f"('{name}', {n}::bigint)" for name, n in {"ScalarMD": 7, "WordMD": 3, "CharMD": 3, "TokenMD": 2, **WIDTHS}.items())
    return {
        "standardize_keys": """
            select p_partkey, case when p_partkey % 7 <> 0 then trim(regexp_replace(p_name || '  ' || p_type, '[ \\t\\r\\n]+', ' ', 'g')) end as std from part""",
        "drop_invalid": f"with {MEASURED} select event_id, std_user, std_type from k",
        "invalid_report": f"with {MEASURED} select count(*) as n_in, count(*) - (select count(*) from k) as n_removed, (select count(*) from k) as n_kept from m",
        "merge_duplicates": f"""
            with {MEASURED},
            q as (select std_user, std_type, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3, count(v) as n, count(*) as n_rows from k group by all)
            select std_user, std_type,
                   round(avg(v) filter (where n < 3 or v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as value, any_value(n_rows) as n_rows
            from k join q using (std_user, std_type) group by std_user, std_type""",
        "first_valid": f"with {MEASURED} select std_user, std_type, arg_min(props, event_id) filter (where props is not null) as props from k group by all",
        "id_value_map_exploded": f"""
            with {MEASURED}, g as (select std_user, std_type from k group by all having count(*) > 1)
            select std_user, std_type, event_id, v as value from k join g using (std_user, std_type) where v is not null""",
        "merge_report": f"""
            with {MEASURED}, g as (select std_user, std_type, count(*) as n from k group by all)
            select coalesce(sum(n), 0)::bigint as n_rows, count(*) as n_groups, (coalesce(sum(n), 0) - count(*))::bigint as n_merged from g""",
        "column_families": """
            select case when p_partkey % 2 = 0 then p_type || '.' || p_brand else p_type end as family, count(*) as n from part group by all""",
        "sanitize": "select event_id, case when event_id % 10 > 2 then round(value::double, 6) end as value from events",
        "split_labeled": """
            select d.doc_id, case when quality is not null then 'labeled' else 'pool' end as part from documents d left join labels l on d.doc_id = l.doc_id""",
        "labeled_docs": "select doc_id, lang from documents where doc_id in (select doc_id from labels)",
        "attach_features": "select l.doc_id, quality, toxic, n_chars, lang from labels l join documents d on l.doc_id = d.doc_id",
        "row_missing_filter": f"with {MATRIX} select vec_id, round(missing_ratio, 6) as missing_ratio from r",
        "column_missing_stats": f"with {MATRIX} select pos, n_rows, n_missing, round(missing_ratio, 6) as missing_ratio, missing_ratio <= 0.1 as kept from s",
        "binary_columns": f"with {MATRIX} select pos, is_binary from s",
        "low_variance": f"with {MATRIX} select pos, round(variance, 6) as variance, not coalesce(is_binary and variance < 0.01, false) as kept from s",
        "avg_rank": f"""
            with {MATRIX} select vec_id, pos, rank() over (partition by pos order by v) + (count(*) over (partition by pos, v) - 1) / 2.0::double as rank
            from kl where v is not null""",
        "pearson_pairs": f"with {MATRIX}, {PAIRS} select i, j, count(*) as n, round(corr(x, y), 6) as corr from p group by i, j",
        "spearman_pairs": f"with {MATRIX}, {PAIRS}, {RANKED} select i, j, n, round(corr, 6) as corr from sp",
        "wide_pairs": f"""
            with e as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
            x as (select vec_id, e || list_transform(flatten(list_transform(range(1, {PRODUCTS}), lambda i: list_transform(range(i + 1, {PRODUCTS} + 1), lambda j: [i, j]))), lambda p: e[p[1]] * e[p[2]]) as f from e),
            l as (select vec_id, unnest(range(len(f)))::int as pos, unnest(f) as v from x),
            k as (select * from l where vec_id % 13 <> pos % 40)
            select a.pos as i, b.pos as j, count(*) as n, round(corr(a.v, b.v), 6) as corr from k a join k b on a.vec_id = b.vec_id and a.pos < b.pos group by all""",
        "phi_pairs": f"""
            with b as (select vec_id, unnest(range({ELEMENTS}))::int as pos, unnest(list_transform(embedding, lambda x: (x > 0)::int::double)) as v from embeddings)
            select a.pos as i, b.pos as j, count(*) as n, round(corr(a.v, b.v), 6) as corr from b a join b on a.vec_id = b.vec_id and a.pos < b.pos group by all""",
        "redundant_features": f"with {MATRIX}, {PAIRS}, {RANKED}, {_losers()} select pos from lo",
        "quality_summary": f"""
            with {MATRIX}, {PAIRS}, {RANKED},
            cm as (select pos from s where missing_ratio <= 0.1),
            cv as (select pos from s where missing_ratio <= 0.1 and not coalesce(is_binary and variance < 0.01, false)),
            {_losers(among='sp.i in (select pos from cv) and sp.j in (select pos from cv)')},
            n as (select count(*) as n from r)
            select 'row_filter' as step, n as "rows", {WIDTH}::bigint as "columns" from n
            union all select 'column_filter', n, (select count(*) from cm) from n
            union all select 'variance_filter', n, (select count(*) from cv) from n
            union all select 'redundancy_removal', n, (select count(*) from cv) - (select count(*) from lo) from n""",
        "quality_table": f"""
            with {MATRIX}, {PAIRS}, {RANKED},
            cv as (select pos from s where missing_ratio <= 0.1 and not coalesce(is_binary and variance < 0.01, false)),
            {_losers(among='sp.i in (select pos from cv) and sp.j in (select pos from cv)')}
            select vec_id, pos, round(v, 6) as v from kl where pos in (select pos from cv) and pos not in (select pos from lo)""",
        "retained_columns": "select p_brand as feature_set, string_agg(p_name, ',' order by p_partkey, p_name) as retained from part group by p_brand",
        "feature_statistics": f"""
            with {MATRIX} select 'Emb.' || pos::varchar as feature, 'Emb' as type, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min,
                   round(max(v), 6) as max, count(*) filter (where v is null) as missing,
                   round(count(*) filter (where v is null) * 100.0::double / count(*), 2) as missing_pct, count(distinct v) as "unique"
            from l group by pos""",
        "extraction_report": f"""
            select s as feature_set, count(*) filter (where p_partkey % 10 <> 0) as n_ok, count(*) filter (where p_partkey % 10 = 0) as n_failed, n as n_features
            from part, (values {sizes}) x(s, n) group by s, n""",
        "tokens": rf"""
            select doc_id, case when len(t) > 0 then len(t)::int end as n_tokens, case when len(t) > 0 then md5(array_to_string(t, '|')) end as md5
            from (select doc_id, regexp_extract_all(text, {WORDS}) as t from documents)""",
        "scalar_descriptors": f"with {DOCS} {descriptors}",
        "path_bits": _bits(_paths),
        "neighbourhood_bits": _bits(_near),
        "pair_bits": _bits(_pair),
        "torsion_bits": f"""
            with {DOCS}, k as ({_keys([_ngrams(4)], 'doc_id')}), b as (select distinct doc_id, {_bucket('key', 2048)} as b from k),
            g as (select doc_id, string_agg(b::varchar, ',' order by b) as s from b group by doc_id)
            select d.doc_id, case when t.doc_id is not null then md5(coalesce(s, '')) end as bits_md5
            from documents d left join t on d.doc_id = t.doc_id left join g on d.doc_id = g.doc_id""",
        "folded_counts": f"""
            with {PARTS}, k as ({_keys(_pair)}) select p_partkey, ({_bucket('key', 4860)})::int as bucket, count(*) as n from k group by all""",
        "literal_keys": f"select doc_id, array_to_string(list_filter([{literals}], lambda k: k is not null), ',') as keys from (select doc_id, translate(text, '{UPPER}', '{UPPER.lower()}') as t from documents)",
        "dictionary_keys": f"select doc_id, concat_ws(',', {keys}) as keys from documents",
        "type_counts": f"with {DOCS} select doc_id, concat_ws(',', {counts}) as counts from t",
        "featurize": """
            select doc_id, 'LengthMD' as feature_set, length(text)::double as n_chars, (length(text) - length(replace(text, ' ', '')))::double as n_blanks,
                   null::varchar as error from documents""",
        "stratified_split": """
            with c as (select lang, count(*) as n, floor(0.2 * count(*) + 1e-9) as base, 0.2 * count(*) - floor(0.2 * count(*) + 1e-9) as rest from documents group by lang),
            e as (select *, row_number() over (order by rest desc, lang) as place, ceil(0.2 * sum(n) over () - 1e-9) - sum(base) over () as more from c),
            k as (select lang, base + case when place <= more then 1 else 0 end as k from e),
            r as (select doc_id, lang, row_number() over (partition by lang order by md5('42|' || doc_id::varchar), doc_id) as rn from documents)
            select doc_id, r.lang from r join k on r.lang = k.lang where rn <= k""",
        "knn": f"with {NEAR} select qid, rank::int as rank, tid, round(sqrt(d2), 6) as dist from nn where rank <= 5",
        "knn_predict": f"with {NEAR} select qid, avg(y::double) as prob, (avg(y::double) > 0.5)::int as pred from nn where rank <= 5 group by qid",
        "knn_elements": f"""
            with {VECTORS}, tr as (select * from e where id % 4 = 0),
            nn as (select po.id as qid, tr.id as tid, {D2} as d2, row_number() over (partition by po.id order by d2, tr.id) as rank from po, tr)
            select qid, rank::int as rank, tid, round(sqrt(d2), 6) as dist from nn where rank <= 5""",
        "loop_one_iteration": f"""
            with {VECTORS},
            c as (select y, count(*) as n, floor(0.2 * count(*) + 1e-9) as base, 0.2 * count(*) - floor(0.2 * count(*) + 1e-9) as rest from e where id % 4 = 0 group by y),
            pl as (select *, row_number() over (order by rest desc, y) as place, ceil(0.2 * sum(n) over () - 1e-9) - sum(base) over () as more from c),
            k as (select y, base + case when place <= more then 1 else 0 end as k from pl),
            o as (select *, row_number() over (partition by y order by md5('42|' || id::varchar), id) as rn from e where id % 4 = 0),
            tr as (select id, f, o.y from o join k on o.y = k.y where rn > k),
            x as (select po.id, tr.y, row_number() over (partition by po.id order by {D2}, tr.id) as rank from po, tr),
            sc as (select id, avg(y::double) as prob from x where rank <= 5 group by id),
            cf as (select *, case when prob >= 0.8 then 1 when prob <= 0.2 then 0 end as pseudo_label from sc),
            n as (select count(*) filter (where pseudo_label = 1) as p, count(*) filter (where pseudo_label = 0) as n from cf),
            t as (select count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from tr),
            q0 as (
                select p, n, case when pos < neg then least(p, neg - pos) else least(p, least(n, pos - neg)) end as a,
                       case when pos < neg then least(n, least(p, neg - pos)) else least(n, pos - neg) end as b from n, t),
            q as (select least(p, greatest(a, 10)) as take_pos, least(n, greatest(b, 10)) as take_neg from q0), {_picked('q')}""",
        "class_distribution": "select quality, count(*) as n from labels group by quality",
        "binary_metrics": f"""
            with {PREDICTED}, {_metrics('model')} select model, tp::bigint as tp, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, {RATES} from g""",
        "roc_auc": f"with {PREDICTED}, {_metrics('model, feature_set')} select model, feature_set, round(roc_auc, 6) as roc_auc from auc",
        "grid_metrics": f"with {GRID} select model, feature_set, seq::int as seq, {RATES} from g",
        "top_configs": f"""
            with {GRID}, o as (select model, feature_set, seq::int as seq, {RATES} from g) select * from o order by roc_auc desc nulls last, seq limit 10""",
        "best_config": f"""
            with {GRID} select model, feature_set, seq::int as seq, round(roc_auc, 6) as roc_auc from g where roc_auc is not null
            order by round(roc_auc, 6) desc, seq limit 1""",
        "confident": f"with {SCORED} select id, prob, pseudo_label::int as pseudo_label from cf",
        "balance_quota": f"with {QUOTA} select take_pos::bigint as take_pos, take_neg::bigint as take_neg from q",
        "two_ended_select": f"with {QUOTA}, {_picked('q')}",
        "selection_history": f"""
            with {QUOTA} select 1 as iteration, take_pos::bigint as n_pos_before_cap, take_neg::bigint as n_neg_before_cap, 0.9::double as threshold_high,
                   0.1::double as threshold_low from q""",
        "cap_select": f"with {QUOTA}, {_cap(51)}, {_picked('cq')}",
        "relax_thresholds": f"""
            with {QUOTA}, {_cap(15)} select case when take_pos < 10 then 0.85::double else 0.9::double end as threshold_high,
                   case when take_neg < 10 then 0.15::double else 0.1::double end as threshold_low from cq""",
        "selection_quality": f"""
            with {SELECTED} select iteration, n_selected, n_positive, n_negative, round(mean_c, 6) as mean_confidence, round(std_c, 6) as std_confidence,
                   round(min_c, 6) as min_confidence, round(max_c, 6) as max_confidence from sq""",
        "quality_totals": f"""
            with {SELECTED} select count(*) as n_iterations, sum(n_selected)::bigint as total_selected, round(avg(n_selected), 6) as mean_selected,
                   round(avg(mean_c), 6) as mean_confidence, sum(n_positive)::bigint as total_positive, sum(n_negative)::bigint as total_negative from sq""",
        "convergence": """
            with recursive h as (
                select event_type as run_id, (user_id % 40 + 1)::int as iteration, round(avg(value), 4) as score from events group by all),
            o as (select *, row_number() over (partition by run_id order by iteration) as rn from h),
            st as (
                select run_id, 0::bigint as rn, '-inf'::double as best, 0 as best_iteration, 0 as waited, null::int as stop_iteration from (select distinct run_id from o)
                union all
                select o.run_id, o.rn, case when x.better then o.score else st.best end, case when x.better then o.iteration else st.best_iteration end,
                       case when x.better then 0 else st.waited + 1 end, case when not x.better and st.waited + 1 >= 8 then o.iteration end
                from st join o on o.run_id = st.run_id and o.rn = st.rn + 1, lateral (select o.score > st.best + 0.01 as better) x
                where st.stop_iteration is null)
            select run_id, best_iteration, best as best_score, stop_iteration
            from (select *, row_number() over (partition by run_id order by rn desc) as last from st) where last = 1""",
        "expand_and_remaining": f"""
            with {FEATURES} select id, y::int as y, 'labeled' as source, 0 as iteration from tr
            union all select id, (id % 2)::int, 'pseudo', 1 from po where id % 3 = 0
            union all select id, null, 'pool', null from po where id % 3 <> 0""",
    }
