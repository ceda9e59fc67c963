"""Text functions as column expressions: answers in solutions, cleaning, topics, verdicts, rankings.

Integers stay canonical texts (no sign for zero, no leading zeros), so they may have any number of digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number, box and fraction patterns, the topics and the features of problems.
NUMBER = "-?[0-9][0-9,]*(?:[.][0-9]+)?"
BOXED = r"boxed *\{((?:[^\{\}]|\{[^\{\}]*\})*)\}"
FRACTION = r"frac *\{ *(-?[0-9]+) *\} *\{ *(-?[0-9]+) *\}"
CANONICAL = r"^(?:0|-?[1-9][0-9]*)\z"
JUNK, DOTS = r"[\s\\,$!;:]", r"^\.+|\.+$"
BOXED_FLAT = r"boxed\{([^\{\}]+)\}"
TOPICS = [
    ("미적분", r"derivative|integral|\bintegrate\b|limit as|tangent line|f'\(|dy/dx|maxima|minima|monotonic"),
    ("수열/급수", r"sequence|arithmetic progression|geometric progression|\bseries\b|sum of the first|a_\{?n|S_\{?n|recursive"),
    ("확률/통계", r"probability|expected value|\bmean\b|median|variance|standard deviation|random|dice|coin|drawn at random"),
    ("조합론", r"how many ways|number of ways|arrangement|permutation|combination|\bchoose\b|distinct arrangements|subsets"),
    ("정수론", r"divisor|divisible|\bprime\b|remainder|modulo|\bmod\b|greatest common|least common|gcd|lcm|digits of|base-?\d+ representation"),
    ("기하", r"triangle|circle|square|rectangle|polygon|angle|radius|diameter|perimeter|\barea\b|volume|parallel|perpendicular|vertex|vertices|coordinate plane|hypotenuse"),
    ("대수/방정식", r"polynomial|equation|solve for|roots of|factor|quadratic|inequality|\bmatrix\b|vector|complex number|logarithm|\blog_|exponent"),
    ("함수", r"\bf\(x\)|\bg\(x\)|function|domain|range of"),
]
OTHER_TOPIC = "기타/문장제"
FEATURES = [
    ("mod/나머지", r"\bmod\b|modulo|remainder|divisible|divisor"),
    ("소수/인수", r"\bprime\b|factoriz|\bfactors?\b|\bgcd\b|\blcm\b|greatest common|least common"),
    ("조합/경우의수", r"how many ways|number of ways|permutation|combination|\bchoose\b|arrangement|subsets"),
    ("확률/기댓값", r"probability|expected value|at random|\bdice\b|\bcoin\b|randomly"),
    ("수열/급수", r"sequence|series|progression|\ba_\{?n|\bs_\{?n|recursive|recurrence"),
    ("기하", r"triangle|circle|square|rectangle|polygon|angle|radius|diameter|perimeter|\barea\b|volume|hypotenuse|vertex|vertices"),
    ("방정식/다항식", r"polynomial|equation|solve for|roots of|quadratic|inequality"),
    ("함수 f(x)", r"\bf\s*\(\s*x|\bg\s*\(\s*x|function|domain of|range of"),
    ("제곱/루트", r"square root|sqrt|\^2|\^3|squared|cubed|\bpower of"),
    ("floor/ceil", r"floor|ceiling|greatest integer|least integer|rounded down|rounded up"),
    ("분수", r"\\frac|\d+\s*/\s*\d+"),
    ("소수점", r"\d+\.\d+"),
    ("경우분석", r"at least|at most|either|otherwise|\bcases\b|if and only if"),
]
MANY_NUMBERS, BIG_NUMBER, LONG_TEXT = "숫자 8개+", "큰수(4자리+)", "긴 문제(180자+)"
STOP = "the a an of to in is are and or for that this with be we can if it as by on find such what how many number let where when then all each are".split()
NO_CORRECT_RATE = {"조합론": 0.400, "수열/급수": 0.294, "정수론": 0.259, "기하": 0.244, "대수/방정식": 0.207, "확률/통계": 0.200, "함수": 0.286, "미적분": 0.667, OTHER_TOPIC: 0.060}
RATE_CAP, DEGENERATE_PENALTY = 0.30, 0.5
DEGENERATE = r"(?i)if we know the answer|unknown variable\s+[A-Za-z]"


def canonical(digits: Column) -> Column:
    """A signed run of digits without leading zeros or a sign of zero."""
    bare = F.regexp_replace(digits, "^[+-]?0*", "")
    return F.when(bare == "", "0").otherwise(F.concat(F.when(F.startswith(digits, F.lit("-")), "-").otherwise(""), bare))


def parse_int(text: Column) -> Column:
    """An integer written with spaces, separators or currency signs, or a float within 1e-6 of one; else null."""
    t = F.regexp_replace(F.regexp_replace(text, JUNK, ""), DOTS, "")
    whole = canonical(F.regexp_replace(t, "_", ""))
    is_float = t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    f = F.when(is_float, t.try_cast("double"))
    near = F.when(F.abs(f - F.rint(f)) < 1e-6, F.rint(f).try_cast("bigint").cast("string"))
    slow = F.when(t.rlike("^[+-]?[0-9]+(?:_[0-9]+)*$"), whole).otherwise(near)
    return F.when(text.rlike(CANONICAL), text).when(text.rlike("[0-9]"), slow)  # most are canonical already, or have no digit


def first_known(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def last_number(text: Column) -> Column:
    return first_known(F.transform(F.reverse(F.regexp_extract_all(text, F.lit(NUMBER), 0)), parse_int))


def fraction(text: Column) -> Column:
    a, b = F.regexp_extract(text, FRACTION, 1).try_cast("bigint"), F.regexp_extract(text, FRACTION, 2).try_cast("bigint")
    return F.when(F.contains(text, F.lit("frac")), F.when((b != 0) & (F.try_mod(a, b) == 0), F.call_function("div", a, F.when(b != 0, b)).cast("string")))


def extract_answer(text: Column) -> Column:
    """The integer of the last box that holds one (a whole fraction, an integer, or its last number), else the text's last number."""
    boxes = F.reverse(F.regexp_extract_all(text, F.lit(BOXED), 1))
    return F.coalesce(first_known(F.transform(boxes, lambda c: F.coalesce(fraction(c), parse_int(c), last_number(c)))), last_number(text))


def extract_flat(text: Column) -> Column:
    """The older extractor: last box without braces inside, else the last integer, else 0."""
    box = F.get(F.reverse(F.regexp_extract_all(text, F.lit(BOXED_FLAT), 1)), F.lit(0))
    return F.coalesce(parse_int(box), last_number(text), F.lit("0"))


def extract_teacher(text: Column) -> Column:
    """Backslashes go first; the last flat box alone counts; its last number is rounded half to even as a double."""
    box = F.get(F.reverse(F.regexp_extract_all(F.replace(text, F.lit("\\"), F.lit("")), F.lit(BOXED_FLAT), 1)), F.lit(0))
    number = F.get(F.reverse(F.regexp_extract_all(F.coalesce(box, text), F.lit(NUMBER), 0)), F.lit(0))
    return F.rint(F.replace(number, F.lit(","), F.lit("")).try_cast("double")).try_cast("bigint")


def boxed_balanced(text: Column) -> Column:
    """The content of the last box with any depth of braces; null if there is none or it never closes."""
    tail = F.substring_index(text, "boxed{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    step = lambda a, c: F.when(a["depth"] == 0, a).otherwise(
        F.struct((a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).cast("int").alias("depth"), (a["n"] + 1).cast("int").alias("n"))
    )
    end = F.aggregate(F.split(tail, ""), start, step)
    return F.when(F.contains(text, F.lit("boxed{")) & (end["depth"] == 0), F.substring(tail, F.lit(1), end["n"] - 1))


def is_pure_integer(box: Column) -> Column:
    t = box
    for junk in ("\\,", "\\!", "\\;", "~", "{,}", ",", " ", "$"):
        t = F.replace(t, F.lit(junk), F.lit(""))
    return F.coalesce(t.rlike(r"^-?\d+$"), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_question(text: Column) -> Column:
    """Without a translation request, images, drawings, a leading number and runs of empty lines."""
    for pattern, new in ((r"(?is)\s*Translate the above text.*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?is)\[asy\].*?\[/asy\]", ""), (r"^\s*\d+\.\s+", ""), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def topic(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.rlike(TOPICS[0][1]), TOPICS[0][0])
    for name, pattern in TOPICS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(OTHER_TOPIC)


def features(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    low, numbers = F.lower(text), F.regexp_extract_all(text, F.lit(r"\d+"), 0)
    out = {name: low.rlike(pattern) for name, pattern in FEATURES}
    return out | {MANY_NUMBERS: F.size(numbers) >= 8, BIG_NUMBER: F.exists(numbers, lambda x: F.length(x) >= 4), LONG_TEXT: F.length(text) >= 180}


def degenerate(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(DEGENERATE)


def priority(text: Column) -> Column:
    """The topic's capped rate of problems nobody solves, less a penalty for degenerate ones."""
    t = topic(text)
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in NO_CORRECT_RATE.items() for x in kv])[t], F.lit(0.2))
    return F.round(F.least(rate, F.lit(RATE_CAP)) - F.when(degenerate(text), DEGENERATE_PENALTY).otherwise(0.0), 4)


def parse_ranking(text: Column, most: int = 3) -> Column:
    """Distinct integers of the last RANKING line, in its order, `most` at most."""
    line = F.get(F.reverse(F.regexp_extract_all(text, F.lit(r"RANKING\s*[:：]\s*(.+)"), 1)), F.lit(0))
    found = F.transform(F.split(line, ">"), lambda x: F.replace(F.regexp_extract(x, "-?[0-9][0-9,]*", 0), F.lit(","), F.lit("")))
    kept = F.transform(F.filter(found, lambda x: x != ""), canonical)
    return F.coalesce(F.slice(F.array_distinct(kept), 1, most), F.array().cast("array<string>"))


def verdict_of(text: Column) -> Column:
    """yes or no within twelve characters after the last 'verdict:'; else null."""
    low = F.lower(text)
    tail = F.left(F.substring_index(low, "verdict:", -1), F.lit(12))
    return F.when(F.contains(low, F.lit("verdict:")), F.when(F.contains(tail, F.lit("yes")), True).when(F.contains(tail, F.lit("no")), False))


def reason_of(text: Column, most: int = 300) -> Column:
    return F.left(strip(F.regexp_extract(text, r"REASON:\s*([^\n]*)", 1)), F.lit(most))


def p_yes(yes: Column, no: Column) -> Column:
    """Two-way softmax of log-probabilities; 0 without a yes, 1 without a no."""
    return F.when(yes.isNull(), 0.0).when(no.isNull(), 1.0).otherwise(1 / (1 + F.exp(no - yes)))


def terms(text: Column) -> Column:
    """Lower-case words of two letters or more without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), 0)
    return F.filter(found, lambda t: ~t.isin(STOP))
