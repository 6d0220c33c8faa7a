"""Queries over text: answer letters, explanations, prompts, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions import extract as X
from gradeframe.functions import text as T
from gradeframe.operators import chat as E
from gradeframe.plans import views as V
from gradeframe.plans.registry import query

WS = K.WHITESPACE  # fixed value: white space that is cut from both ends
S = r"[\s\x0b\x85\pZ]"
W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"

OUTPUTS = """outputs as (select doc_id, lang, case doc_id % 7
    when 0 then text
    when 1 then concat('<think>', text, '</think>', chr(10), 'Final answer: **', pick, '**')
    when 2 then concat(text, chr(10), '**', pick, '**.')
    when 3 then concat('Explanation: ', text, chr(10), 'Answer: **', pick, '** then answer - c')
    when 4 then concat('So the answer is ', pick, '. ', text)
    when 5 then concat(' ', lower(pick), chr(10)) end as raw_output
  from (select *, substr('ABCD', cast((doc_id // 7) % 4 as int) + 1, 1) as pick from documents))"""


def _first(text, pattern, flags=""):
    """First match; the character behind the letter is looked at, not captured."""
    return f"nullif(regexp_extract({text}, '{flags}{pattern}(?:{NW}|$)', 1), '')"


def _last(text, pattern, flags=""):
    return f"nullif(regexp_extract({text}, '(?s{flags})^.*{pattern}(?:{NW}|\\z)', 1), '')"


STAND_FIRST = f"nullif(regexp_extract(upper(t), '(?:^|{NW})([A-D])(?:{NW}|$)', 1), '')"
STAND_LAST = f"nullif(regexp_extract(upper(t), '(?s)^(?:.*{NW})?([A-D])(?:{NW}|\\z)', 1), '')"
AFTER = f"""after as (select doc_id, trim(regexp_replace(trim(raw_output, '{WS}'), '(?s)^.*</think>', ''), '{WS}') as t, raw_output from outputs)"""
WITHOUT = f"""without as (select doc_id, trim(regexp_replace(raw_output, '(?s)<think>.*?</think>', '', 'g'), '{WS}') as t, raw_output from outputs)"""
WHOLE = "case when upper(t) in ('A','B','C','D') then upper(t) end"
TAG = rf"[Aa]nswer{S}*[:\-]?{S}*\**{S}*([A-Da-d])"
FINAL = rf"[Ff]inal{S}+[Aa]nswer{S}*[:\-]?{S}*\**{S}*([A-Da-d])"
IS = rf"the{S}+answer{S}+is{S}+\**{S}*([A-D])"


def _extract(rule):
    def run(spark, sf):
        rows = V.model_outputs(spark, sf)
        return X.with_letter(rows, "raw_output", rule).select("doc_id", "pred_answer")
    return run


query("C1_extract_direct_first", f"""with {OUTPUTS}, {AFTER} select doc_id,
  coalesce({WHOLE}, {STAND_FIRST}, nullif(regexp_extract(upper(t), 'ANSWER{S}*[:\\-]?{S}*([A-D])', 1), '')) as pred_answer from after""")(
    _extract("direct_first"))

query("C2_extract_cot_first", f"""with {OUTPUTS}, {AFTER}, lines as (select doc_id, t, string_split(t, chr(10)) as l from after),
  three as (select doc_id, t, list_reverse(l[greatest(len(l) - 2, 1):len(l)]) as l3 from lines),
  bare as (select doc_id, t, list_filter(list_transform(l3, lambda x: upper(trim(replace(trim(rtrim(trim(x, '{WS}'), '.'), '{WS}'), '*', ''), '{WS}'))),
    lambda x: x in ('A','B','C','D')) as b from three)
  select doc_id, upper(coalesce({_first('t', FINAL)}, {_first('t', TAG)}, {_first('t', IS, '(?i)')}, b[1], {STAND_LAST})) as pred_answer from bare""")(
    _extract("cot_first"))

query("C3_extract_tagged_last", f"""with {OUTPUTS}, {AFTER} select doc_id,
  upper(coalesce({WHOLE}, {_last('t', TAG)}, {_last('t', IS, 'i')}, {STAND_LAST})) as pred_answer from after""")(
    _extract("tagged_last"))

query("C4_extract_explained", f"""with {OUTPUTS}, {WITHOUT} select doc_id,
  upper(coalesce({_first('t', rf'Answer:{S}*\**{S}*([ABCD])', '(?i)')}, {STAND_LAST})) as pred_answer from without""")(
    _extract("explained"))

query("C5_extract_letter_only", f"""with {OUTPUTS}, r as (select doc_id, raw_output as t from outputs) select doc_id, {STAND_FIRST} as pred_answer from r""")(
    _extract("letter_only"))


@query("C6_extract_explanation", f"""with {OUTPUTS}, {WITHOUT},
  x as (select doc_id, t, regexp_extract(t, '(?is)Explanation:{S}*(.+?)(?:\\nAnswer:|\\z)', 1) as e from without)
  select doc_id, case when e <> '' then trim(e, '{WS}') else substr(t, 1, 500) end as explanation from x""")
def c6(spark, sf):
    return V.model_outputs(spark, sf).select("doc_id", X.extract_explanation(F.col("raw_output")).alias("explanation"))


@query("C7_normalize_text", "select doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as norm from documents")
def c7(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


SOLUTIONS = """solutions as (select doc_id, case doc_id % 4 when 0 then concat(text, ' The Correct Answer is ', pick, '.')
    when 1 then concat('The solution is ', lower(pick), ': ', text) when 2 then concat('Solution: the correct answer is', chr(10), pick, '. ', text,
    ' see Figure 3, Fig. 12 and Table 4; then Figure 3, Chart  9 [Image: images/a', doc_id, '.png] and [Image: b.png]') else text end as s
  from (select *, substr('ABCD', cast((doc_id // 4) % 4 as int) + 1, 1) as pick from documents))"""


def _solutions(spark, sf):
    style, text, pick = F.col("doc_id") % 4, F.col("text"), V.letter(F.floor(F.col("doc_id") / 4))
    s = (
        F.when(style == 0, F.concat(text, F.lit(" The Correct Answer is "), pick, F.lit(".")))
        .when(style == 1, F.concat(F.lit("The solution is "), F.lower(pick), F.lit(": "), text))
        .when(style == 2, F.concat(
            F.lit("Solution: the correct answer is\n"), pick, F.lit(". "), text,
            F.lit(" see Figure 3, Fig. 12 and Table 4; then Figure 3, Chart  9 [Image: images/a"), F.col("doc_id"),
            F.lit(".png] and [Image: b.png]"),
        ))
        .otherwise(text)
    )
    return V.table(spark, sf, "documents").select("doc_id", s.alias("s"))


@query("C8_answer_from_solution", f"""with {SOLUTIONS} select doc_id, upper(coalesce(
  nullif(regexp_extract(s, '(?i)correct answer is{S}+([A-D])', 1), ''), nullif(regexp_extract(s, '(?i)The solution is{S}+([A-D])', 1), ''))) as answer
  from solutions""")
def c8(spark, sf):
    return _solutions(spark, sf).select("doc_id", X.answer_from_solution(F.col("s")).alias("answer"))


@query("C9_figure_refs", f"""with {SOLUTIONS}, f as (select doc_id, list_sort(list_distinct(list_transform(list_concat(
    regexp_extract_all(s, '(?:^|{NW})((?:Figure|Fig\\.){S}*[0-9]+)', 1), regexp_extract_all(s, '(?:^|{NW})(Table{S}+[0-9]+)', 1),
    regexp_extract_all(s, '(?:^|{NW})((?:Graph|Diagram|Chart){S}+[0-9]+)', 1)), lambda x: trim(x, '{WS}')))) as refs from solutions)
  select doc_id, array_to_string(refs, '|') as refs from f""")
def c9(spark, sf):
    return _solutions(spark, sf).select("doc_id", F.array_join(X.figure_refs(F.col("s")), "|").alias("refs"))


@query("C10_images", f"""with {SOLUTIONS} select doc_id, trim(regexp_replace(s, '{S}*\\[Image: [^\\]]+\\]', '', 'g'), '{WS}') as plain,
  array_to_string(regexp_extract_all(s, '\\[Image: ([^\\]]+)\\]', 1), '|') as images from solutions""")
def c10(spark, sf):
    return _solutions(spark, sf).select(
        "doc_id", X.strip_images(F.col("s")).alias("plain"), F.array_join(X.image_list(F.col("s")), "|").alias("images")
    )


@query("C11_top_label", """select vec_id, substr('ABCD', cast(list_position(e, list_max(e)) as int), 1) as top
  from (select vec_id, list_transform(embedding[1:4], lambda x: cast(x as double)) as e from embeddings)""")
def c11(spark, sf):
    scored = F.array(*[
        F.struct(F.lit(f"option {x}").alias("label"), F.col("embedding")[i].cast("double").alias("score"))
        for i, x in enumerate(K.LABELS)
    ])
    return V.table(spark, sf, "embeddings").select("vec_id", X.top_label(scored).alias("top"))


# --- prompts over the item view of the documents -------------------------------------------


def _items(spark, sf):
    d = F.col("doc_id")
    return V.table(spark, sf, "documents").select(
        d.alias("id"), F.col("text").alias("question"), F.col("source").alias("opa"), F.col("lang").alias("opb"),
        F.col("n_chars").cast("string").alias("opc"), F.when(d % 5 != 0, "none").alias("opd"),
        (d % 6).cast("int").alias("cop"), F.when(d % 3 == 0, F.concat(F.lit(" "), "lang", F.lit("\n"))).alias("exp"),
        F.when(d % 4 != 0, F.col("source")).alias("subject_name"), F.col("lang").alias("topic_name"),
    )


ITEMS = """items as (select doc_id as id, text as question, source as opa, lang as opb, cast(n_chars as varchar) as opc,
    case when doc_id % 5 <> 0 then 'none' else '' end as opd, doc_id % 6 as cop, case when doc_id % 3 = 0 then lang end as exp,
    case when doc_id % 3 = 0 then concat(' ', lang, chr(10)) end as raw_exp, doc_id,
    case when doc_id % 6 between 1 and 4 then substr('ABCD', cast(doc_id % 6 as int), 1) else 'A' end as letter, source, lang from documents)"""
NL = "chr(10)"
OPTS = f"concat('A. ', opa, {NL}, 'B. ', opb, {NL}, 'C. ', opc, {NL}, 'D. ', opd)"
FORMAT = f"concat('Think step by step. Then respond in the format:', {NL}, 'Explanation: ...', {NL}, 'Answer: <one of A, B, C, D>')"


def _eval_sql(image=""):
    return f"concat('Question: ', question, {NL}, {image} 'Options:', {NL}, {OPTS}, {NL}, {NL}, {FORMAT})"


IMAGE = f"'Image Description: [not used in Stage 1]', {NL},"


@query("E1_to_chat", f"""with {ITEMS} select cast(id as varchar) as id, coalesce(case when id % 4 <> 0 then source end, 'Unknown') as subject_name, lang as topic_name,
  'system|user|assistant' as roles, {_eval_sql(IMAGE)} as user_text,
  concat('Explanation: ', coalesce(exp, concat('The correct answer is ', letter, ' based on medical knowledge.')), {NL}, 'Answer: ', letter) as reply from items""")
def e1(spark, sf):
    return E.to_chat(_items(spark, sf)).select(
        "id", "subject_name", "topic_name",
        F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
        F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("reply"),
    )


@query("E2_eval_prompt", f"with {ITEMS} select id, {_eval_sql()} as prompt, {_eval_sql(IMAGE)} as prompt_with_image from items")
def e2(spark, sf):
    return _items(spark, sf).select(
        "id", E.eval_prompt().alias("prompt"), E.eval_prompt(image_line=True).alias("prompt_with_image")
    )


def _samples(spark, sf):
    d = F.col("doc_id")
    subject = F.try_element_at(F.array(*[F.lit(x) for x in ("cars", "BB", "cp", "PS", "other")]), (d % 5 + 1).cast("int"))
    return V.table(spark, sf, "documents").select(
        d.alias("id"), F.when(d % 3 != 0, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise("  ").alias("passage"),
        F.concat(F.lit("What of "), "source", F.lit("? ")).alias("question"), subject.alias("subject_category"),
        F.when(d % 7 != 0, F.create_map(F.lit("A"), F.col("lang"), F.lit("B"), F.col("source"), F.lit("D"), F.lit("none")))
        .otherwise(F.create_map(F.lit("A"), F.col("lang"))).alias("choices"),
    )


SAMPLES = f"""samples as (select doc_id as id, case when doc_id % 3 <> 0 then trim(text, '{WS}') else '' end as passage, concat('What of ', source, '?') as question,
    lang as a, case when doc_id % 7 <> 0 then source else '' end as b, case when doc_id % 7 <> 0 then 'none' else '' end as d, doc_id % 5 as s from documents)"""
CHOICES = f"concat('A. ', a, {NL}, 'B. ', b, {NL}, 'C. ', {NL}, 'D. ', d)"
BODY = f"'Passage:', {NL}, passage, {NL}, {NL}, 'Question:', {NL}, question, {NL}, {NL}, 'Choices:', {NL}, {CHOICES}"


@query("E3_passage_prompt", f"""with {SAMPLES} select id, concat({BODY}, {NL}, {NL}, 'Return only one capital letter: A, B, C, or D.', {NL}) as prompt from samples""")
def e3(spark, sf):
    return _samples(spark, sf).select("id", E.passage_prompt().alias("prompt"))


def _sql_text(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_case(texts, default):
    order = ["CARS", "BB", "CP", "PS"]
    return "case s " + " ".join(f"when {i} then {_sql_text(texts[c])}" for i, c in enumerate(order)) + f" else {_sql_text(default)} end"


@query("E4_cot_messages", f"""with {SAMPLES} select id, {_sql_case(K.SUBJECT_SYSTEM_PROMPTS, K.DEFAULT_SYSTEM_PROMPT)} as system_text,
  concat('/no_think', {NL}, {_sql_case(K.SUBJECT_INSTRUCTIONS, K.DEFAULT_INSTRUCTIONS)}, {NL}, {NL}, {BODY}, {NL}) as user_text from samples""")
def e4(spark, sf):
    m = E.cot_messages()
    return _samples(spark, sf).select("id", m[0]["content"].alias("system_text"), m[1]["content"].alias("user_text"))


@query("E5_tuned_messages", f"""with {SAMPLES} select id, concat(case when passage <> '' then concat('Passage: ', passage, {NL}, {NL}) else '' end,
  'Question: ', question, {NL}, 'Options: A. ', a, ' B. ', b, ' C.  D. ', d, {NL}, {FORMAT}) as user_text from samples""")
def e5(spark, sf):
    return _samples(spark, sf).select("id", E.tuned_messages()[1]["content"].alias("user_text"))


@query("E6_option_pairs", f"""with {ITEMS}, o as (select id, nullif(exp, '') as context, question, unnest([opa, opb, opc, opd]) as opt,
    unnest([0, 1, 2, 3]) as option_index from items)
  select id, context, cast(option_index as int) as option_index, substr('ABCD', option_index + 1, 1) as letter, concat(question, ' ', opt) as text from o""")
def e6(spark, sf):
    return E.option_pairs(_items(spark, sf).select("id", "question", "opa", "opb", "opc", "opd", "exp"))


@query("E6_cross_text", f"""with {ITEMS}, x as (select id, raw_exp, concat('Question: ', question, ' Options: A. ', opa, ' B. ', opb, ' C. ', opc, ' D. ', opd) as t from items)
  select id, case when raw_exp is not null then concat('Context: ', raw_exp, ' ', t) else t end as text from x""")
def e6_cross(spark, sf):
    return _items(spark, sf).select("id", E.cross_text().alias("text"))


@query("E7_prompts", f"""with {ITEMS}, h as (select *, concat('Question: ', question, {NL}, {OPTS}, {NL}, {NL}) as head from items)
  select id, concat(head, 'Respond with only a single letter: A, B, C, or D.', {NL}, 'Answer:') as answer_text,
    case when id % 2 = 0 then concat(head, 'The correct answer is ', letter, '. Please explain in 2-3 sentences why this is the right answer, focusing on the key medical concept.')
    else concat(head, 'The correct answer is ', letter, ' (the student answered D). Please explain in 2-3 sentences why ', letter,
      ' is correct and why D is incorrect, focusing on the key medical concept.') end as explain_text,
    concat('You are a medical expert. Answer this multiple-choice question.', {NL}, 'Think step by step, then provide your answer.', {NL}, {NL},
      'Question: ', question, {NL}, {NL}, 'Options:', {NL}, '  A. ', opa, {NL}, '  B. ', opb, {NL}, '  C. ', opc, {NL}, '  D. ', opd, {NL},
      case when exp is not null then concat({NL}, 'Context:', {NL}, exp, {NL}) else '' end, {NL},
      'Think step by step. Then respond in the format:', {NL}, 'Explanation: <your reasoning>', {NL}, 'Answer: <one of A, B, C, D>') as independent_text
  from h""")
def e7(spark, sf):
    rows = _items(spark, sf).withColumns({
        "option_a": F.col("opa"), "option_b": F.col("opb"), "option_c": F.col("opc"), "option_d": F.col("opd"),
        "correct_answer": E.cop_to_letter(F.col("cop")), "student_answer": F.lit("D"), "is_correct": F.col("id") % 2 == 0,
    })
    return rows.select(
        "id", E.answer_prompt().alias("answer_text"), E.explain_prompt().alias("explain_text"),
        E.independent_prompt().alias("independent_text"),
    )


@query("E9_group_turns", """select conv_id, string_agg(role, '|' order by turn) as roles, string_agg(text, chr(10) order by turn) as texts,
  count(*) as n from conversations group by 1""")
def e9(spark, sf):
    grouped = E.group_turns(V.table(spark, sf, "conversations"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
        F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("texts"),
        F.size("messages").cast("bigint").alias("n"),
    )


RULES = """r as (select conv_id, list(role order by turn) as roles, list(text order by turn) as texts from conversations group by 1),
  v as (select conv_id, unnest(list_filter([case when len(roles) <> 3 then 'message_count' end,
    case when roles[1] is distinct from 'system' then 'role_0_not_system' end, case when roles[2] is distinct from 'user' then 'role_1_not_user' end,
    case when roles[3] is distinct from 'assistant' then 'role_2_not_assistant' end,
    case when conv_id % 3 = 0 then 'missing_answer' end,
    case when not contains(coalesce(texts[2], ''), 'Choices:') then 'missing_choices' end], lambda x: x is not null)) as rule from r)"""


@query("D11_validate_records", f"with {RULES} select rule, count(*) as n from v group by 1")
def d11(spark, sf):
    records = E.group_turns(V.table(spark, sf, "conversations")).withColumn(
        "correct_answer", F.when(F.col("conv_id") % 3 != 0, V.letter(F.col("conv_id")))
    )
    return E.violation_counts(E.validate_records(records))
