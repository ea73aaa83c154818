"""Text functions as Column builders.  Patterns avoid what differs between regular expression engines (``\\b``, ``\\s``, look-around)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode counts as white space.
WS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|\z)"

# How an answer, a score and a verdict are written.
LEAD = rf"^{WS}*[（(]?{WS}*([A-Ea-e]){_AFTER}"
EXPLICIT = rf"(?:答案|正确答案|选择)(?:[是为：:]|{WS})*([A-Ea-e])"
ANY_LETTER = rf"{_BEFORE}([A-Ea-e]){_AFTER}"
SCORE_MARK = rf"分数[：:]{WS}*([1-5])"
SCORE_LEAD = rf"^{WS}*([1-5]){_AFTER}"
SCORE_ANY = r"([1-5])"
WINNER_MARK = r"^(?:获胜者|Winner):"
THINK = r"(?s)<think>.*?</think>"
THINK_OPEN = r"(?s)<think>.*\z"
# The prompts.
TEACHER_PREFIX = (
    "请回答下面这道医学单项选择题。\n"
    "要求：\n"
    "1) 第一行只输出答案字母（A/B/C/D/E 中的一个），不要加标点、括号或汉字；\n"
    "2) 第二行起用 1-2 句话（不超过 80 字）简要说明理由；\n"
    "3) 不要输出思考过程、不要重复题目。\n\n"
)
RUBRIC = "评分标准：\n5 = 答案正确, 且解释准确、专业、详尽\n4 = 答案正确, 解释合理但不够深入\n3 = 答案正确但无解释, 或答案错误但分析有一定道理\n2 = 答案错误, 解释有明显缺陷\n1 = 答案错误且无合理分析\n\n题目：\n{prompt}\n\n学生答案：\n{text}\n\n请评分。"
PAIRWISE = (
    "Compare these two answers for the same question.\n\nQuestion: {question}\n\nAnswer A: {answer_a}\nAnswer B: {answer_b}\n\n"
    "Which answer is better? Rate each 1-5 on:\n1. Accuracy\n2. Completeness\n3. Clarity\n\nRespond in JSON format:\n"
    '{{"winner": "A" or "B" or "tie", "score_a": {{accuracy: N, completeness: N, clarity: N}}, "score_b": {{accuracy: N, completeness: N, clarity: N}}, "reason": "..."}}'
)
EVOLVE = {
    "constraints": "Add more constraints or requirements to this question.",
    "deepening": "Increase the reasoning depth required to answer this question.",
    "concretizing": "Make this question more specific and concrete.",
    "reasoning": "Rewrite to require step-by-step reasoning.",
}


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included.  Only a text that has some there is searched."""
    ends = F.regexp_like(F.substring(c, 1, 1), F.lit(WS)) | F.regexp_like(F.substring(c, -1, 1), F.lit(WS))
    return F.when(ends, F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")).otherwise(c)


def collapse(c: Column) -> Column:
    """Stripped, and each run of white space as one space."""
    return F.regexp_replace(strip(c), rf"{WS}+", " ")


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def extract_answer(c: Column) -> Column:
    """The answer's letter, upper case: the leading one, else one after an explicit mark, else the first that stands alone."""
    return F.upper(F.coalesce(_found(c, LEAD), _found(c, EXPLICIT), _found(c, ANY_LETTER)))


def lead_letter(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(LEAD)), F.lit(False))


def parse_score(c: Column) -> Column:
    """1 to 5: after the mark, else at the start of the first line that begins with one, else the first there is."""
    lines = F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    first = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, SCORE_LEAD, 1)), lambda x: x != ""), F.lit(0))
    return F.coalesce(_found(c, SCORE_MARK), first, _found(c, SCORE_ANY)).cast("int")


def parse_winner(c: Column) -> Column:
    """A, B or tie by the first line that announces a winner; a tie if none does or it is unclear."""
    line = F.get(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.regexp_like(x, F.lit(WINNER_MARK))), F.lit(0))
    said = strip(F.regexp_replace(line, "^[^:]*:", ""))
    a, b = said.contains("A"), said.contains("B")
    tie = said.contains("平局") | F.lower(said).contains("tie")
    return F.when(tie, "tie").when(a & ~b, "A").when(b & ~a, "B").otherwise("tie")


def strip_think(c: Column) -> Column:
    """Without closed thinking blocks, and without what follows one that was never closed."""
    return strip(F.regexp_replace(F.regexp_replace(c, THINK, ""), THINK_OPEN, ""))


def last_content(messages: Column) -> Column:
    """A completion's text: the last turn's content."""
    return F.element_at(messages, -1)["content"]


def mcq_prompt(question: Column, options: Column) -> Column:
    lines = F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")
    return F.concat(question, F.lit("\n"), lines, F.lit("\n答案："))


def real_completion(answer: Column, explanation: Column) -> Column:
    return F.concat(F.upper(strip(answer)), F.lit("\n"), strip(explanation))


def teacher_message(prompt: Column) -> Column:
    return F.concat(F.lit(TEACHER_PREFIX), prompt)


def distill_completion(text: Column, gold: Column) -> Column:
    """struct(completion, letter, status): as it is if a letter leads, else with the parsed letter before it, else the gold one."""
    body = strip_think(text)
    letter = extract_answer(body)
    leads = lead_letter(body)
    used = F.coalesce(letter, gold)
    return F.struct(
        F.when(leads, body).otherwise(F.concat(used, F.lit("\n"), body)).alias("completion"),
        F.when(leads, F.upper(F.regexp_extract(body, LEAD, 1))).otherwise(used).alias("letter"),
        F.when(leads, "compliant").when(letter.isNotNull(), "recovered_teacher").otherwise("recovered_gold").alias("status"),
    )


def filled(template: str, **columns: Column) -> Column:
    """A template with {name} places; doubled braces are plain ones."""
    parts, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{" + n + "}") for n in columns) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest.replace("{{", "{").replace("}}", "}")))
            break
        parts.append(F.lit(rest[:at].replace("{{", "{").replace("}}", "}")))
        name = next(n for n in columns if rest.startswith("{" + n + "}", at))
        parts.append(columns[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def judge_prompt(prompt: Column, text: Column) -> Column:
    return filled(RUBRIC, prompt=prompt, text=text)


def pairwise_prompt(question: Column, a: Column, b: Column) -> Column:
    return filled(PAIRWISE, question=question, answer_a=a, answer_b=b)


def evolve_instruction(strategy: Column) -> Column:
    """An unknown strategy deepens."""
    out = F.lit(EVOLVE["deepening"])
    for name, said in EVOLVE.items():
        out = F.when(strategy == name, said).otherwise(out)
    return out


def seconds_of_day(c: Column) -> Column:
    part = F.split(c, ":")
    return part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")


def number4(c: Column) -> Column:
    """A number rounded to 4 places; null where it is none."""
    return F.round(c.try_cast("double"), 4)


def ratio_parts(ratio: str) -> tuple[int, int]:
    domain, general = ratio.split("-")
    return int(domain), int(general)


def best_accuracy(metrics: Column) -> Column:
    """The accuracy in a map of metrics: acc, acc_norm, with or without a filter's name, else the first key like it that is no error."""
    named = [F.try_element_at(metrics, F.lit(k)).try_cast("double") for k in ("acc", "acc,none", "acc_norm", "acc_norm,none")]
    other = F.filter(F.map_keys(metrics), lambda k: k.contains("acc") & ~k.contains("stderr"))
    return F.coalesce(*named, F.try_element_at(metrics, F.get(other, F.lit(0))).try_cast("double"))
