"""The derived tables of ``views`` as DuckDB text, to be put in front of an oracle query."""

PREDICTIONS = """
raw_predictions as (
  select 'bench_v1' as experiment_tag,
    concat('test_set_0', l_orderkey % 7 + 1) as eval_split_name,
    concat('model_', l_suppkey % 5) as model_key,
    ['org0/Model 0 Q4_K_M', 'org1/Model 1 LoRA', 'org2/Model 2 Q4_K_M', 'org3/Model 3 LoRA',
     'org4/Model 4 Q4_K_M'][cast(l_suppkey % 5 + 1 as int)] as model_display_name,
    concat(l_orderkey, '-', l_linenumber) as question_id,
    case when p_size % 17 = 0 then null else p_brand end as subject_category,
    case when l_partkey % 53 = 0 then null else substr('ABCD', cast(l_partkey % 4 as int) + 1, 1) end as gold_answer,
    case when l_orderkey % 29 = 0 then null
         when (l_orderkey + l_linenumber) % 5 < 3 then substr('ABCD', cast(l_partkey % 4 as int) + 1, 1)
         else substr('ABCD', cast((l_partkey + l_linenumber) % 4 as int) + 1, 1) end as pred_answer,
    round_even(l_extendedprice / 1000 * 10000, 0) / 10000 as latency_s,
    case when l_suppkey % 5 = 4 then null else cast(l_quantity as bigint) * 10 end as prompt_tokens,
    case when l_suppkey % 5 = 4 then null else cast(l_linenumber as bigint) * 25 end as completion_tokens,
    case when l_returnflag = 'R' then 'length' else 'stop' end as finish_reason,
    l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_orderkey, l_linenumber
  from lineitem join part on l_partkey = p_partkey
), predictions as (
  select *, prompt_tokens + completion_tokens as total_tokens,
    coalesce(pred_answer = gold_answer, false) as correct,
    case when completion_tokens <> 0 and latency_s > 0
         then round_even(cast(completion_tokens as double) / latency_s * 100, 0) / 100 end as tokens_per_sec
  from raw_predictions
)"""


def mean(c: str) -> str:
    return r(f"avg({c})", 9)


def total(c: str) -> str:
    return r(f"sum({c})", 9)


def r(expression: str, places: int) -> str:
    """Half-even rounding of a double."""
    if places == 0:
        return f"round_even(cast({expression} as double), 0)"
    return f"(round_even(cast({expression} as double) * {10**places}.0::double, 0) / {10**places}.0::double)"


def mean_int(c: str) -> str:
    return f"(cast(sum({c}) as double) / count({c}))"


def rate(condition: str) -> str:
    return f"(cast(count(*) filter (where {condition}) as double) / count(*))"


def quantile(c: str, p: float) -> str:
    """Interpolated quantile from the two neighbouring ranks."""
    values = f"list_sort(list({c}) filter (where {c} is not null))"
    at = f"((count({c}) - 1)::double * {p}::double)"
    lo, hi = f"({values}[floor({at})::bigint + 1])", f"({values}[ceil({at})::bigint + 1])"
    f = f"({at} - floor({at}))"
    if p == 0.5:
        return f"(case when {f} = 0 then {lo} else ({lo} + {hi}) / 2.0::double end)"
    return (f"(case when {f} >= 0.5 then {hi} - ({hi} - {lo}) * (1.0::double - {f}) "
            f"else {lo} + ({hi} - {lo}) * {f} end)")


def macro(by: str = "") -> str:
    """Select list items for macro precision, recall and F1 over predictions."""
    g, p = "coalesce(gold_answer, 'INVALID')", "coalesce(pred_answer, 'INVALID')"
    prec, rec, f1 = [], [], []
    for x in "ABCD":
        tp = f"(count(*) filter (where {g} = '{x}' and {p} = '{x}'))::double"
        pp = f"(count(*) filter (where {p} = '{x}'))::double"
        gg = f"(count(*) filter (where {g} = '{x}'))::double"
        pr = f"(case when {pp} > 0 then {tp} / {pp} else 0 end)"
        rc = f"(case when {gg} > 0 then {tp} / {gg} else 0 end)"
        prec.append(pr)
        rec.append(rc)
        f1.append(f"(case when {pr} + {rc} > 0 then 2 * {pr} * {rc} / ({pr} + {rc}) else 0 end)")
    def ordered(items):
        return "((" + " + ".join([items[0], *items[1:]]) + ") / 4)"
    return (
        f"{r(ordered(prec), 4)} as macro_precision, {r(ordered(rec), 4)} as macro_recall, "
        f"{r(ordered(f1), 4)} as macro_f1"
    )
