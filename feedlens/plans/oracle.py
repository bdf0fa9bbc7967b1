"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code, straight from the operator
definitions: plain windows, ``row_number`` over a global order, correlated
``unnest`` — fine for a check at small scale, and deliberately not the
Spark plan.  Character classes, accent folding and the token pattern are
DuckDB's own, so a fault in the library's tables shows.
"""

from __future__ import annotations

from feedlens.functions import fixed
from feedlens.operators.tokens import FIRST_TOKEN_ID, MAX_LEARNED
from feedlens.plans.fixtures import BATCH_SQL, FB_RAW_SQL

ALPHAS = (0.25, 0.5, 1.0, 2.0)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# Patterns of its own: RE2's classes and DuckDB's strip_accents, not the library's tables.
_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_ENDS = q(rf"\A{_WS}+|{_WS}+\z")
_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
TOKPAT = q(_CJK + r"|[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]")
CJK_GROUP = q(f"({_CJK})")
NA_LIST = ", ".join(q(v) for v in fixed.PANDAS_NA_VALUES)
R1 = float(fixed.TRAIN_RATIO)
R2 = float(fixed.TRAIN_RATIO + fixed.VAL_RATIO)


def clean(c: str) -> str:
    return f"regexp_replace(replace(coalesce({c}, 'nan'), '\"', ''), {WS_ENDS}, '', 'g')"


def tokens(c: str) -> str:
    norm = f"regexp_replace(strip_accents(lower({c})), {CJK_GROUP}, ' \\1 ', 'g')"
    return f"regexp_extract_all({norm}, {TOKPAT})"


def na_null(c: str) -> str:
    return f"case when {c} in ({NA_LIST}) then null else {c} end"


def display(c: str) -> str:
    return f"case when length({c}) > 100 then substring({c}, 1, 100) || '...' else {c} end"


def pct(c: str, d: int = 2) -> str:
    return f"printf('%.{d}f%%', ({c}) * 100)"


def name_of(c: str) -> str:
    return f"case {c} when 0 then 'Negative' when 1 then 'Neutral' when 2 then 'Positive' end"


# --------------------------------------------------------------------------
# CTE chain
# --------------------------------------------------------------------------

CLEAN_CTES = f"""
raw as ({FB_RAW_SQL}),
cr as (select ord, {clean('text')} as text, {clean('sentiment')} as sentiment from raw),
lab as (select ord, text, sentiment,
          cast(case sentiment when 'Negative' then 0 when 'Neutral' then 1
                              when 'Positive' then 2 end as integer) as label from cr),
nb0 as (select * from lab where label is not null and text is not null),
nb1 as (select * from nb0 where length(text) > 0),
clean as (select ord, text, sentiment, label from
           (select *, row_number() over (partition by text order by ord) as rn from nb1) where rn = 1)
"""

SPLIT_CTES = CLEAN_CTES + f""",
rk as (select *, row_number() over (order by md5('{fixed.SEED}:' || text), text) - 1 as rnk,
              count(*) over () as n_rows from clean),
bounds as (select *, cast(floor(n_rows * {R1}::double) as bigint) as e1,
                     cast(floor(n_rows * {R2!r}::double) as bigint) as e2 from rk),
sp as (select ord, text, sentiment, label, rnk, n_rows,
         case when rnk < e1 then 'train' when rnk < e2 then 'validation' else 'test' end as split,
         rnk - case when rnk < e1 then 0 when rnk < e2 then e1 else e2 end as pos
       from bounds),
spb as (select *, pos // {fixed.BATCH_SIZE} as batch_id from sp)
"""


def weights_ctes(alpha_rows: str = "(values (0, 1.0::double)) a(cand, alpha)") -> str:
    """Token counts on train, smoothed weights of every train token per
    candidate; and the capped vocabulary of the id space (T4)."""
    return SPLIT_CTES + f""",
tr as (select ord, text, label from sp where split = 'train'),
tt as (select label, unnest({tokens('text')}) as token from tr),
tc as (select token, count(*) as n,
         sum(case when label = 0 then 1 else 0 end) as c0,
         sum(case when label = 1 then 1 else 0 end) as c1,
         sum(case when label = 2 then 1 else 0 end) as c2 from tt group by token),
vocab as (select * from (select token, n,
            row_number() over (order by n desc, token) - 1 + {FIRST_TOKEN_ID} as id
            from tc where n >= 2) where id < {FIRST_TOKEN_ID + MAX_LEARNED}),
vc as (select * from tc),
tot as (select sum(c0)::double as t0, sum(c1)::double as t1, sum(c2)::double as t2,
               count(*)::double as v from vc),
pri as (select count(*)::double as nn, sum(case when label = 0 then 1 else 0 end)::double as n0,
               sum(case when label = 1 then 1 else 0 end)::double as n1,
               sum(case when label = 2 then 1 else 0 end)::double as n2 from tr),
alphas as (select * from {alpha_rows}),
wts as (
  select a.cand, vc.token,
    round(ln((vc.c0::double + a.alpha) / (tot.t0 + a.alpha * tot.v)), 12)::decimal(18,12) as w0,
    round(ln((vc.c1::double + a.alpha) / (tot.t1 + a.alpha * tot.v)), 12)::decimal(18,12) as w1,
    round(ln((vc.c2::double + a.alpha) / (tot.t2 + a.alpha * tot.v)), 12)::decimal(18,12) as w2
  from vc, tot, alphas a
  union all
  select a.cand, '' as token,
    round(ln((pri.n0 + 1.0) / (pri.nn + 3.0)), 12)::decimal(18,12),
    round(ln((pri.n1 + 1.0) / (pri.nn + 3.0)), 12)::decimal(18,12),
    round(ln((pri.n2 + 1.0) / (pri.nn + 3.0)), 12)::decimal(18,12)
  from pri, alphas a)
"""


def score_ctes(docs: str, key: str, name: str, wname: str = "wts", by_cand: bool = False) -> str:
    """Scores of ``docs(key, text, ...)`` as CTE ``name``: z0..z2, p0..p2,
    pred, confidence (unrounded)."""
    cand = "cand, " if by_cand else ""
    wcand = "w.cand, " if by_cand else ""
    join_docs = (f"{docs} d join (select distinct cand from {wname}) cc on true"
                 if by_cand else f"{docs} d")
    dcols = "cc.cand, d.*" if by_cand else "d.*"
    zjoin = "using (cand, " + key + ")" if by_cand else f"using ({key})"
    return f""",
{name}_ex as (select {key}, unnest(case when text is null then null
                   else list_prepend('', {tokens('text')}) end) as token from {docs}),
{name}_z as (select {wcand}e.{key}, sum(w.w0) as z0, sum(w.w1) as z1, sum(w.w2) as z2
             from {name}_ex e join {wname} w using (token) group by {wcand}e.{key}),
{name}_d as (select {dcols} from {join_docs}),
{name}_s as (select d.*, z.z0::double as z0, z.z1::double as z1, z.z2::double as z2
             from {name}_d d left join {name}_z z {zjoin}),
{name}_e as (select *, exp(z0 - greatest(z0, z1, z2)) as e0, exp(z1 - greatest(z0, z1, z2)) as e1,
                     exp(z2 - greatest(z0, z1, z2)) as e2 from {name}_s),
{name}_p as (select *, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1,
                     e2 / (e0 + e1 + e2) as p2,
                     case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as pred
              from {name}_e),
{name} as (select * exclude (e0, e1, e2),
             case pred when 0 then p0 when 1 then p1 else p2 end as confidence
           from {name}_p where z0 is not null)
"""


W1 = "wts1"
NB_CTES = weights_ctes() + f""",
{W1} as (select token, w0, w1, w2 from wts where cand = 0)
"""

BATCH_CTES = NB_CTES + f""",
bdocs as ({BATCH_SQL})""" + score_ctes("bdocs", "doc_id", "bs", W1)

TEST_CTES = NB_CTES + """,
tdocs as (select ord, text, label from sp where split = 'test')""" + score_ctes("tdocs", "ord", "ts_", W1)


def metric_ctes(preds: str, group: str = "", px: str = "") -> str:
    """Per-class counts and metrics of ``preds(y, p[, group])`` as CTEs
    ``{px}cm, {px}pc, {px}met``."""
    g = f"{group}, " if group else ""
    gsel = f"k.{group}, " if group else ""
    keys = (f"(select distinct {group} from {preds})" if group else "(select 1 as one)")
    on_g = f"and cm.{group} = k.{group}" if group else ""
    return f""",
{px}cm as (select {g}y, p, count(*) as n from {preds} group by {g}y, p),
{px}keys as {keys},
{px}cls as (select * from (values (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')) c(cls, sentiment)),
{px}pc0 as (select {gsel}c.cls, c.sentiment,
          coalesce(sum(case when cm.y = c.cls and cm.p = c.cls then cm.n else 0 end), 0)::double as tp,
          coalesce(sum(case when cm.y = c.cls then cm.n else 0 end), 0)::double as n_true,
          coalesce(sum(case when cm.p = c.cls then cm.n else 0 end), 0)::double as n_pred
        from {px}keys k cross join {px}cls c
        left join {px}cm cm on (cm.y = c.cls or cm.p = c.cls) {on_g}
        group by {gsel}c.cls, c.sentiment),
{px}pc as (select *, case when n_pred > 0 then tp / n_pred else 0.0 end as precision,
                 case when n_true > 0 then tp / n_true else 0.0 end as recall,
                 case when n_true + n_pred > 0 then 2 * tp / (n_true + n_pred) else 0.0 end as f1,
                 (n_true > 0 or n_pred > 0) as present from {px}pc0),
{px}met as (select {g}sum(n_true)::bigint as n, sum(tp) / sum(n_true) as accuracy,
               avg(case when present then precision end) as precision,
               avg(case when present then recall end) as recall,
               avg(case when present then f1 end) as f1_macro,
               sum(f1 * n_true) / sum(n_true) as f1_weighted
        from {px}pc {"group by " + group if group else ""})
"""


def metrics_select(src: str = "met", extra: str = "") -> str:
    return (f"select {extra}n, round(accuracy, 6) as accuracy, round(precision, 6) as precision, "
            f"round(recall, 6) as recall, round(f1_macro, 6) as f1_macro, "
            f"round(f1_weighted, 6) as f1_weighted from {src}")


TEST_METRICS = (TEST_CTES + """,
tpred as (select label as y, pred as p from ts_)""" + metric_ctes("tpred"))


def probs_select(src: str, key: str) -> str:
    return (f"select {key}, pred, round(confidence, 4) as confidence, round(p0, 4) as p0, "
            f"round(p1, 4) as p1, round(p2, 4) as p2 from {src}")


def result_select(src: str) -> str:
    return (f"select {display('text')} as \"Text\", {name_of('pred')} as \"Sentiment\", "
            f"{pct('confidence')} as \"Confidence\", {pct('p0')} as \"Negative\", "
            f"{pct('p1')} as \"Neutral\", {pct('p2')} as \"Positive\" from {src}")


def w(ctes: str, body: str) -> str:
    return "with " + ctes.strip().lstrip(",") + "\n" + body


def _examples_values() -> str:
    rows = []
    for cat, texts in fixed.EXAMPLES.items():
        for i, t in enumerate(texts):
            rows.append(f"({q(cat)}, {i}, {q(t)}, {q(cat + ':' + str(i))})")
    return "(values " + ", ".join(rows) + ") e(category, idx, text, doc_id)"


ALPHA_ROWS = "(values " + ", ".join(f"({i}, {a}::double)" for i, a in enumerate(ALPHAS)) + ") a(cand, alpha)"
CAND_CTES = weights_ctes(ALPHA_ROWS) + """,
vdocs as (select ord, text, label from sp where split = 'validation')""" + \
    score_ctes("vdocs", "ord", "vs", "wts", by_cand=True) + """,
vpred as (select cand, label as y, pred as p from vs)""" + metric_ctes("vpred", "cand") + """,
ebc as (select m.cand::integer as cand, a.alpha, m.n, round(accuracy, 6) as accuracy,
          round(precision, 6) as precision, round(recall, 6) as recall,
          round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted
        from met m join alphas a using (cand))"""

TRAIN_EVAL_CTES = CAND_CTES + """,
best as (select cand from met order by f1_macro desc, cand limit 1),
wbest as (select token, w0, w1, w2 from wts join best using (cand)),
tdocs as (select ord, text, label from sp where split = 'test')""" + \
    score_ctes("tdocs", "ord", "bt", "wbest")

HISTORY = """
h as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step,
             value as metric from events),
hb as (select *, max(metric) over (partition by run order by step
                  rows between unbounded preceding and 1 preceding) as pb from h),
hi as (select *, max(case when pb is null or metric > pb then step end) over (partition by run
                  order by step rows between unbounded preceding and current row) as li from hb)
"""

DATASETS = NB_CTES + """,
tok as (select ord, split, batch_id, label, """ + tokens("text") + """[1:126] as t from spb),
ex as (select ord, unnest(t) as token, unnest(range(len(t))) as p from tok),
ids as (select ex.ord, ex.p, coalesce(v.id, 100) as id from ex left join vocab v using (token)),
agg as (select ord, list(id order by p) as l from ids group by ord),
seqs as (select t.*, list_concat(list_concat([101], coalesce(a.l, [])), [102]) as seq
         from tok t left join agg a using (ord)),
padded as (select *, len(seq) as n_real, max(len(seq)) over (partition by split, batch_id) as width
           from seqs),
ds as (select *, array_to_string(list_resize(seq, width, 0), ' ') as input_ids,
              rtrim(repeat('1 ', n_real::bigint) || repeat('0 ', (width - n_real)::bigint)) as attention_mask
       from padded)
"""


REPORT = """
select sentiment as row, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1, n_true::bigint as support from pc
union all select 'accuracy', null, null, round(accuracy, 6), n from met
union all select 'macro avg', round(precision, 6), round(recall, 6), round(f1_macro, 6), n from met
union all select 'weighted avg', round(sum(precision * n_true) / sum(n_true), 6),
       round(sum(recall * n_true) / sum(n_true), 6), round(sum(f1 * n_true) / sum(n_true), 6),
       sum(n_true)::bigint from pc"""

MATRIX = """
select t.c::integer as truth, p.c::integer as pred, coalesce(cm.n, 0)::bigint as n
from (select y as c from cm union select p from cm) t
cross join (select y as c from cm union select p from cm) p
left join cm on cm.y = t.c and cm.p = p.c"""

LABEL_PREDS = """
ly as (select doc_id, case when toxic = 1 then 0 when quality = 0 then 1 else 2 end as y from labels
       where quality is not null and toxic is not null),
lp as (select y, case when doc_id % 5 = 0 then (y + 1) % 3 when doc_id % 7 = 0 then (y + 2) % 3 else y end as p from ly)
"""


LINEAR = dict(epochs=6, lr=8.0, weight_decay=0.001, patience=2)


def linear_ctes(epochs: int, lr: float, weight_decay: float, patience: int) -> str:
    """The hashed softmax regression, one group of CTEs an epoch: weights
    ``lw{e}``, history ``lh`` up to the stop, and the best epoch's ``lw``."""
    def vectors(name: str, docs: str, cols: str) -> str:
        return f"""
{name}_t as (select {cols}, unnest({tokens('text')}) as token from {docs} where text is not null),
{name}_b as (select {cols}, ('0x' || substr(md5(token), 1, 4))::integer as bucket, count(*) as tf from {name}_t group by all),
{name} as materialized (select {cols}, bucket, tf / sqrt(sum(tf * tf) over (partition by {cols})) as x from {name}_b
         union all select {cols}, 65536, 1.0 from {docs} where text is not null)"""

    def softmax(name: str, feats: str, weights: str, cols: str) -> str:
        return f"""
{name}_z as (select {cols}, sum(x * coalesce(w0, 0)) as z0, sum(x * coalesce(w1, 0)) as z1, sum(x * coalesce(w2, 0)) as z2
             from {feats} left join {weights} using (bucket) group by {cols}),
{name}_e as (select *, exp(z0 - greatest(z0, z1, z2)) as e0, exp(z1 - greatest(z0, z1, z2)) as e1, exp(z2 - greatest(z0, z1, z2)) as e2 from {name}_z),
{name} as materialized (select {cols}, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2,
           case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as pred from {name}_e)"""

    parts = [SPLIT_CTES.strip(), vectors("lf", "(select ord, label, split, text from sp where split <> 'test') q", "ord, label, split"),
             """
lt as materialized (select ord, label, bucket, x from lf where split = 'train'),
lv as materialized (select ord, label, bucket, x from lf where split = 'validation'),
lw0 as (select 0 as bucket, 0.0::double as w0, 0.0::double as w1, 0.0::double as w2)"""]
    for e in range(1, epochs + 1):
        step = ", ".join(f"coalesce(w{k}, 0) * (case when g.bucket = 65536 then 1.0 else {1.0 - lr * weight_decay!r}::double end) - {lr}::double * g{k} as w{k}"
                         for k in range(3))
        parts += [softmax(f"lp{e}", "lt", f"lw{e - 1}", "ord, label"), f"""
lg{e} as (select bucket, """ + ", ".join(f"sum(x * (p{k} - case when label = {k} then 1 else 0 end)) / (select count(*) from lp{e}) as g{k}" for k in range(3))
                  + f""" from lt join lp{e} using (ord, label) group by bucket),
lw{e} as materialized (select g.bucket, {step} from lg{e} g left join lw{e - 1} using (bucket)),
ll{e} as (select avg(-ln(greatest(case label when 0 then p0 when 1 then p1 else p2 end, 1e-300))) as loss from lp{e})""",
                  softmax(f"lq{e}", "lv", f"lw{e}", "ord, label"), f"""
lr{e} as (select label as y, pred as p from lq{e})""", metric_ctes(f"lr{e}", px=f"l{e}_").strip().lstrip(",")]
    every = " union all ".join(f"select {e} as epoch, loss, l{e}_met.* from l{e}_met, ll{e}" for e in range(1, epochs + 1))
    weights = " union all ".join(f"select {e} as epoch, * from lw{e}" for e in range(1, epochs + 1))
    parts.append(f"""
la as (select *, max(f1_macro) over (order by epoch rows between unbounded preceding and 1 preceding) as pb from ({every})),
lb as (select *, max(case when pb is null or f1_macro > pb then epoch end) over (order by epoch) as li from la),
lh as (select * from lb where epoch <= coalesce((select min(epoch) from lb where epoch - li >= {patience}), {epochs})),
lbest as (select epoch from lh order by f1_macro desc, epoch limit 1),
lw as materialized (select bucket, w0, w1, w2 from ({weights}) join lbest using (epoch))""")
    return ",\n".join(parts)


def external_scores() -> str:
    """The best epoch's model on every conversation turn."""
    base = linear_ctes(**LINEAR)
    score = f"""
xd as ({BATCH_SQL}),
xt as (select doc_id, unnest({tokens('text')}) as token from xd where text is not null),
xb as (select doc_id, ('0x' || substr(md5(token), 1, 4))::integer as bucket, count(*) as tf from xt group by all),
xf as (select doc_id, bucket, tf / sqrt(sum(tf * tf) over (partition by doc_id)) as x from xb
       union all select doc_id, 65536, 1.0 from xd where text is not null),
xz as (select doc_id, sum(x * coalesce(w0, 0)) as z0, sum(x * coalesce(w1, 0)) as z1, sum(x * coalesce(w2, 0)) as z2
       from xf left join lw using (bucket) group by doc_id),
xe as (select *, exp(z0 - greatest(z0, z1, z2)) as e0, exp(z1 - greatest(z0, z1, z2)) as e1, exp(z2 - greatest(z0, z1, z2)) as e2 from xz),
xp as (select doc_id, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2,
              case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as pred from xe),
xs as (select *, case pred when 0 then p0 when 1 then p1 else p2 end as confidence from xp)"""
    return w(base + "," + score, probs_select("xs", "doc_id"))


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["train_history"] = w(linear_ctes(**LINEAR), "select epoch::integer as epoch, round(loss, 6) as loss, n, round(accuracy, 6) as accuracy, "
                           "round(precision, 6) as precision, round(recall, 6) as recall, round(f1_macro, 6) as f1_macro, "
                           "round(f1_weighted, 6) as f1_weighted, epoch = (select epoch from lbest) as best from lh")
    o["fit_stop_point"] = w(linear_ctes(**LINEAR), "select count(*)::bigint as n_steps, (select epoch from lbest)::bigint as best_step, "
                            "round(max(f1_macro), 6) as best_metric, "
                            f"(select min(epoch) from lh where epoch - li >= {LINEAR['patience']})::bigint as stop_step from lh")
    o["linear_fit"] = w(linear_ctes(**LINEAR), "select bucket, round(w0, 6) as w0, round(w1, 6) as w1, round(w2, 6) as w2 from lw")
    o["score_external"] = external_scores()
    o["prepare_feedback"] = w(CLEAN_CTES, "select ord, text, sentiment, label from clean")
    o["clean_text"] = w(CLEAN_CTES, "select ord, text, sentiment from cr")
    o["label_encode"] = w(CLEAN_CTES, "select ord, sentiment, label from lab")
    o["drop_unlabelled"] = w(CLEAN_CTES, "select ord, text, label from nb0")
    o["nonblank"] = w(CLEAN_CTES, "select ord, text, label from nb1")
    o["dedupe_first"] = w(CLEAN_CTES, "select text, ord, label from clean")
    o["norm_columns"] = (f"select ord as doc_id, {na_null('text')} as text, "
                         f"{na_null('sentiment')} as sentiment from ({FB_RAW_SQL})")
    o["src_feedback_csv"] = w(CLEAN_CTES, "select ord as doc_id, text, sentiment, label from clean")
    o["src_batch_csv"] = f"select coalesce({na_null('text')}, 'nan') as text from conversations"
    o["src_text_lines"] = """
select doc_id, line_no, line from (
  select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::integer as line_no,
         regexp_replace(unnest(string_split(text, chr(10))), """ + WS_ENDS + """, '', 'g') as line
  from documents) where length(line) > 0"""
    o["display_text"] = f"select doc_id, {display('text')} as display from documents"
    o["class_distribution"] = w(CLEAN_CTES, """
select sentiment, n, row_number() over (order by n desc, first_seen)::integer as rnk
from (select sentiment, count(*) as n, min(ord) as first_seen from clean group by sentiment)""")
    o["class_share"] = w(CLEAN_CTES, """
select sentiment, n, round(n / sum(n) over (), 6) as share,
       printf('%.1f%%', n / sum(n) over () * 100) as pct
from (select sentiment, count(*) as n from clean group by sentiment)""")
    o["stage_counts"] = w(SPLIT_CTES, """
select 'loaded' as stage, count(*)::bigint as n from lab
union all select 'labelled', count(*) from nb0
union all select 'nonblank', count(*) from nb1
union all select 'unique', count(*) from sp
union all select 'train', count(*) from sp where split = 'train'
union all select 'validation', count(*) from sp where split = 'validation'
union all select 'test', count(*) from sp where split = 'test'""")
    o["seeded_shuffle"] = w(SPLIT_CTES, "select ord, rnk from sp")
    o["split_80_10_10"] = w(SPLIT_CTES, "select ord, label, rnk, split, pos from sp")
    o["mini_batches"] = w(SPLIT_CTES, "select ord, split, batch_id, pos from spb")
    o["early_stop_point"] = w(HISTORY, """
select run, max(step) as n_steps, max(li) as best_step, max(metric) as best_metric,
       min(case when step - li >= """ + str(fixed.EARLY_STOPPING_PATIENCE) + """ then step end) as stop_step
from hi group by run""")
    o["eval_by_candidate"] = w(CAND_CTES, "select * from ebc")
    o["best_candidate"] = w(CAND_CTES, "select * from ebc order by f1_macro desc, cand limit 1")
    o["tokenize"] = f"""
select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, chr(1))) as tokens_md5
from (select doc_id, {tokens('text')} as t from documents)"""
    o["truncate_tokens"] = f"""
select doc_id, len(t)::bigint as n_kept, md5(array_to_string(t, chr(1))) as kept_md5
from (select doc_id, {tokens('text')}[1:126] as t from documents)"""
    o["build_vocab"] = w(NB_CTES, "select token, id::integer as id, n::bigint as n from vocab")
    o["encode_ids"] = w(DATASETS.replace("[1:126] as t from spb", " as t from spb"), """
select ord, split, (n_real - 2)::integer as n_ids,
       len(list_filter(seq, lambda x: x = 100))::integer as n_unk,
       array_to_string(seq[2:n_real - 1], ' ') as ids from ds""")
    o["pad_batches"] = w(DATASETS, """
select ord, split, batch_id, width::integer as width, n_real::integer as n_real,
       input_ids, attention_mask from ds""")
    o["make_datasets"] = w(DATASETS, """
select split, ord, batch_id, input_ids, attention_mask, label as labels from ds""")
    o["nb_fit"] = w(NB_CTES, f"""
select token, round(w0::double, 9) as w0, round(w1::double, 9) as w1, round(w2::double, 9) as w2
from {W1}""")
    o["softmax"] = w(BATCH_CTES, "select doc_id, round(p0, 4) as p0, round(p1, 4) as p1, round(p2, 4) as p2 from bs")
    o["argmax_class"] = w(BATCH_CTES, "select doc_id, pred, round(z0, 6) as z0, round(z1, 6) as z1, round(z2, 6) as z2 from bs")
    o["score_batch"] = w(BATCH_CTES, probs_select("bs", "doc_id"))
    o["label_decode"] = w(BATCH_CTES, f"select doc_id, pred, {name_of('pred')} as class_name from bs")
    o["score_record"] = w(BATCH_CTES, f"""
select doc_id, text, {name_of('pred')} as predicted_class, round(confidence, 4) as confidence,
       round(p0, 4) as "Negative", round(p1, 4) as "Neutral", round(p2, 4) as "Positive" from bs""")
    o["format_pct"] = w(BATCH_CTES, f"""
select doc_id, {pct('confidence')} as confidence_pct, {pct('p0')} as "Negative",
       {pct('p1')} as "Neutral", {pct('p2')} as "Positive" from bs""")
    o["result_table"] = w(BATCH_CTES, result_select("bs"))
    o["sink_results_csv"] = w(BATCH_CTES, result_select("bs").replace(" from bs", ", row_number() over (order by doc_id) - 1 as ord from bs"))
    o["prob_distribution"] = w(BATCH_CTES, f"""
select doc_id, cls, {name_of('cls')} as sentiment, round(pr * 100, 2) as pct,
       printf('%.1f%%', pr * 100) as bar_label
from (select doc_id, unnest([0, 1, 2])::integer as cls, unnest([p0, p1, p2]) as pr from bs)""")
    o["confidence_bands"] = w(BATCH_CTES, """
select case when confidence * 100 < 50 then '0-50' when confidence * 100 < 75 then '50-75'
            else '75-100' end as band, count(*) as n,
       sum(case when confidence * 100 >= 90 then 1 else 0 end)::bigint as n_above_threshold
from bs group by 1""")
    o["sentiment_summary"] = w(BATCH_CTES, """
select c.cls, c.sentiment, coalesce(x.n, 0)::bigint as n
from (values (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')) c(cls, sentiment)
left join (select pred, count(*) as n from bs group by pred) x on x.pred = c.cls""")
    o["drop_failed"] = w(NB_CTES + """,
fdocs as (select ord as doc_id, text from raw)""" + score_ctes("fdocs", "doc_id", "fs", W1),
                         "select doc_id, pred from fs")
    o["score_examples"] = w(NB_CTES + f""",
edocs as (select * from {_examples_values()})""" + score_ctes("edocs", "doc_id", "es", W1), """
select category, idx, """ + name_of("pred") + """ as predicted_class,
       round(confidence, 4) as confidence from es""")
    o["model_roundtrip"] = w(TEST_CTES, probs_select("ts_", "ord"))
    o["eval_metrics"] = w(TEST_METRICS, metrics_select())
    o["sink_metrics_json"] = o["eval_metrics"]
    o["metrics_long"] = w(TEST_METRICS, """
select metric, round(value, 6) as value from (
  select 'accuracy' as metric, accuracy as value from met
  union all select 'precision', precision from met
  union all select 'recall', recall from met
  union all select 'f1_macro', f1_macro from met
  union all select 'f1_weighted', f1_weighted from met)""")
    o["classification_report"] = w(TEST_METRICS, REPORT)
    o["confusion_matrix"] = w(TEST_METRICS, MATRIX)
    o["train_eval_nb"] = w(TRAIN_EVAL_CTES + """,
bpred as (select label as y, pred as p from bt)""" + metric_ctes("bpred", px="b_"),
                           metrics_select("b_met"))
    o["batch_analysis"] = w(NB_CTES + f""",
bdocs as (select doc_id, coalesce({na_null('text')}, 'nan') as text from ({BATCH_SQL}))""" +
                            score_ctes("bdocs", "doc_id", "bs", W1), result_select("bs"))
    o["score_udf"] = o["score_batch"]
    o["stream_score"] = o["score_batch"]
    o["stream_summary"] = o["sentiment_summary"]
    ba = NB_CTES + f""",
bdocs as (select doc_id, coalesce({na_null('text')}, 'nan') as text from ({BATCH_SQL}))""" + score_ctes("bdocs", "doc_id", "bs", W1)
    o["batch_summary"] = w(ba, """
select c.sentiment, coalesce(x.n, 0)::bigint as n,
       coalesce(printf('%.1f%%', x.n / (select count(*) from bs) * 100), '-') as pct,
       (select count(*) from bs) as n_analysed, 0::bigint as n_failed
from (values (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')) c(cls, sentiment)
left join (select pred, count(*) as n from bs group by pred) x on x.pred = c.cls""")
    o["typed_results"] = w(ba, f"""
select {name_of('pred')} as predicted_class, round(confidence, 4) as confidence,
       round(p0, 4) as "Negative", round(p1, 4) as "Neutral", round(p2, 4) as "Positive" from bs""")
    o["score_one"] = w(NB_CTES + """,
odocs as (select 0 as ord, text from conversations order by conv_id, turn limit 1)""" + score_ctes("odocs", "ord", "os", W1), f"""
select text, {name_of('pred')} as predicted_class, round(confidence, 4) as confidence from os""")
    o["lr_fit"] = w(SPLIT_CTES, """
select count(*) as n, 0::bigint as bad_probabilities, 0::bigint as bad_classes, 0::bigint as bad_confidences
from sp where split = 'test'""")
    o["lr_model_roundtrip"] = w(SPLIT_CTES, "select count(*) as n, 0::bigint as mismatches from sp where split = 'test'")
    o["train_metrics"] = w(SPLIT_CTES, """
select count(*) as n_train, true as iterations_ok, true as objective_ok, true as accuracy_ok, true as f1_ok
from sp where split = 'train'""")
    o["train_job"] = w(SPLIT_CTES, """
select (select count(*) from raw) as loaded, count(*) as unique_rows, count(*) filter (split = 'train') as train,
       count(*) filter (split = 'validation') as validation, count(*) filter (split = 'test') as test,
       0::bigint as metrics_that_differ from sp""")
    lp = LABEL_PREDS + metric_ctes("lp").lstrip()
    o["eval_all_classes"] = w(lp, metrics_select())
    o["report_all_classes"] = w(lp, REPORT)
    o["matrix_all_classes"] = w(lp, MATRIX)
    o["summary_all_classes"] = w(lp, f"""
select p as cls, {name_of('p')} as sentiment, count(*) as n,
       printf('%.1f%%', count(*) / (select count(*) from lp) * 100) as pct from lp group by p""")
    return o
