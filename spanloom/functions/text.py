"""Text expressions. Offsets and lengths count code points; patterns say what white space they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text rules.
FULL_WIDTH, HALF_WIDTH = "（）：，；！？、", "():,;!?,"
ROMAN = {
    "Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "Ⅺ": "XI", "Ⅻ": "XII",
    "ⅰ": "i", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅴ": "v", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅹ": "x", "ⅺ": "xi", "ⅻ": "xii",
}
FUNCTION_WORDS = "功能|系统|模块|装置|单元|组件"
ITEM_ID = r"<\s*[^>]*[A-Za-z][^>]*\d[^>]*>|<\s*[^>]*\d[^>]*[A-Za-z][^>]*>"
SENTENCE_END = r"[。；;！!？?\n]+"
LIST_LINE = r"^\s*(?:[-•●]|\d+[)）]|[a-zA-Z][)）])\s*(.+)$"
CLASS_CODE = r"(?i)F[\-\s]?SC\s*([1-4])"
PRIVATE_USE = "[-]"
CJK = "一-鿿"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def half_width(text: Column) -> Column:
    text = F.translate(text, FULL_WIDTH, HALF_WIDTH)
    for sign, letters in ROMAN.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def normalised(text: Column) -> Column:
    """The form in which characters are compared: widths, private signs, list marks, white space, endings and look-alikes removed."""
    t = half_width(strip(text))
    t = F.regexp_replace(t, PRIVATE_USE, "")
    t = F.regexp_replace(t, r"(?Umd)^\s*[-•●·]\s*", "")
    t = F.regexp_replace(t, r"(?Umd)^\s*(?:\d+[)）]|[a-zA-Z][)）])", "")
    t = compact(t)
    t = F.regexp_replace(t, r"[；;。，,：:!?]+$", "")
    t = F.regexp_replace(t, rf"(?:{FUNCTION_WORDS})$", "")
    for before, letter, after, digit in (("[A-Z]", "l", r"(?=[A-Z\d])", "1"), ("[A-Z]", "l", "$", "1"), (r"\d", "l", "(?=[A-Z])", "1"), (r"\d", "O", r"(?=\d)", "0"), (r"\d", "o", r"(?=\d)", "0")):
        # the letter is looked for before what stands around it
        t = F.regexp_replace(t, rf"{letter}(?<={before}{letter}){after}", digit)
    return t


def purified(phrase: Column) -> Column:
    """A phrase without its number, closing signs and, if long, its generic last word."""
    plain = strip(phrase)
    t = strip(F.regexp_replace(plain, r"(?U)^\s*(?:\d+[)）]|[a-zA-Z][)）]|[-•●·]\s*)", ""))
    t = F.regexp_replace(t, r"(?U)[；;。，,\s]+$", "")
    shorter = strip(F.regexp_replace(t, rf"(?U)(?:{FUNCTION_WORDS})[；;。，,：:\s]*$", ""))
    t = F.when((F.length(t) > 10) & (F.length(shorter) >= 3), shorter).otherwise(t)
    return F.when(t == "", plain).otherwise(t)


def characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def bigrams(text: Column, single: bool = False) -> Column:
    """Distinct pairs of neighbouring characters; a lone character counts as one only if ``single``."""
    # the text is taken apart once a side, since taking a substring reads it from its start
    chars, n = characters(text), F.greatest(F.length(text) - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b)))
    alone = F.array(text) if single else F.array().cast("array<string>")
    return F.when(F.length(text) >= 2, pairs).when(F.length(text) == 1, alone).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normal_char_set_jaccard(a: Column, b: Column) -> Column:
    """Of texts in normal form."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard(F.array_distinct(characters(a)), F.array_distinct(characters(b))))


def char_set_jaccard(a: Column, b: Column) -> Column:
    return normal_char_set_jaccard(normalised(a), normalised(b))


def normal_bigram_jaccard(a: Column, b: Column) -> Column:
    """Of texts in normal form."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard(bigrams(a, True), bigrams(b, True)))


def bigram_jaccard(a: Column, b: Column) -> Column:
    return normal_bigram_jaccard(normalised(a), normalised(b))


def containment(a: Column, b: Column) -> Column:
    """Share of the shorter text's pairs of characters that the longer has; the first counts as shorter on a tie."""
    shorter = F.when(F.length(a) <= F.length(b), bigrams(a)).otherwise(bigrams(b))
    longer = F.when(F.length(a) <= F.length(b), bigrams(b)).otherwise(bigrams(a))
    return F.when(F.size(shorter) == 0, 0.0).otherwise(F.size(F.array_intersect(shorter, longer)) / F.size(shorter))


def sentences(text: Column, least: int = 4, pattern: str = SENTENCE_END) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: F.length(s) >= least)


def list_items(text: Column, least: int = 3) -> Column:
    """Lines without their list marks and closing signs."""

    def item(line: Column) -> Column:
        marked = F.regexp_extract(line, "(?U)" + LIST_LINE, 1)
        return F.regexp_replace(F.when(marked != "", strip(marked)).otherwise(strip(line)), "[；;。]+$", "")

    return F.filter(F.transform(F.split(text, "\n"), item), lambda s: F.length(s) >= least)


def tokens(text: Column) -> Column:
    """Technical words and pairs of neighbouring CJK characters, with repetitions."""
    t = F.upper(normalised(text))
    words = F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z0-9\-/.]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.zip_with(F.slice(F.split(r, ""), F.lit(1), F.length(r) - 1), F.slice(F.split(r, ""), F.lit(2), F.length(r) - 1), lambda a, b: F.concat(a, b))))
    return F.concat(words, pairs)


def words(text: Column, least: int = 2) -> Column:
    """Lower-case Latin words, for texts without CJK."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def class_codes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLASS_CODE), F.lit(1)), lambda d: F.concat(F.lit("F-SC"), d)))


def class_mismatch(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def id_core(raw: Column) -> Column:
    """Last group of letters and digits of an id, in lower case and without leading zeros."""
    s = F.regexp_replace(F.regexp_replace(strip(raw), "^[<>]+|[<>]+$", ""), "[ \n]", "")
    letters = F.try_element_at(F.regexp_extract_all(s, F.lit(r"([A-Za-z]+)(\d+)"), F.lit(1)), F.lit(-1))
    digits = F.try_element_at(F.regexp_extract_all(s, F.lit(r"([A-Za-z]+)(\d+)"), F.lit(2)), F.lit(-1))
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(letters.isNull(), F.lower(s)).otherwise(F.concat(F.lower(letters), plain))


def normal_id(raw: Column) -> Column:
    """An id without white space just inside its brackets."""
    s = strip(raw)
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^<\s+", "<"), r"(?U)\s+>$", ">")


def normal_reference(ref: Column) -> Column:
    """A reference without white space and enumeration signs, brackets in half width."""
    return F.translate(compact(ref), "（）、", "()")


def leading_number(ref: Column) -> Column:
    return F.regexp_extract(strip(ref), r"^(\d+(?:\.\d+)*)", 1)


def section_numbers(number: Column) -> Column:
    """A section number as comparable integers."""
    parts = F.filter(F.split(F.regexp_replace(number, r"\.+$", ""), r"\."), lambda p: p.rlike(r"^\d+$"))
    return F.transform(parts, lambda p: p.cast("int"))


def document_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[A-Za-z0-9]+$", "")


def sheet_name(name: Column, default: str = "Sheet") -> Column:
    clean = F.substring(strip(F.regexp_replace(name, r"[:\\/?*\[\]]", "")), 1, 31)
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def text_width(line: Column) -> Column:
    """Columns that a line takes: wide characters count twice."""
    return F.length(line) + F.length(F.regexp_replace(line, r"[\x00-\x7F]", ""))


def visible_lines(text: Column, column_width: int) -> Column:
    """Lines that a cell of a column shows."""
    room = max(4, column_width - 2)
    each = F.transform(F.split(text, "\n"), lambda line: F.greatest(F.lit(1), F.ceil(text_width(line) / room).cast("int")))
    return F.greatest(F.lit(1), F.aggregate(each, F.lit(0), lambda a, b: a + b))


def generous_lines(text: Column, column_width: int) -> Column:
    """[K4] Lines that a cell of a backward sheet gets: a seventh more for long texts, since words wrap early; null as empty."""
    n = visible_lines(F.coalesce(text, F.lit("")), column_width)
    return F.greatest(n, F.floor(n * F.lit(1.15)).cast("int") + (n > 3).cast("int"))


def html_escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def clipped(text: Column, most: int) -> Column:
    """A long text's start, with a note of its whole length."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…(截断, 原文"), F.length(text).cast("string"), F.lit("字)"))).otherwise(text)


def outermost_json(text: Column) -> Column:
    """From the first brace to the last; null without any."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def evidence(sem: Column, contain: Column, idf: Column, anchor: Column, hits: Column, mismatch: Column, own: Column, other: Column) -> Column:
    """Channels of a candidate as text, with class codes that exclude each other and up to three anchors."""
    scores = F.format_string("语义%.2f 包含%.2f 稀有词%.2f 锚点%.2f", sem, contain, idf, anchor)
    listed = lambda codes: F.when(F.size(codes) > 0, F.array_join(F.sort_array(codes), ", ")).otherwise("未声明")
    classes = F.when(mismatch, F.concat(F.lit(" | 分级不符(下游"), listed(own), F.lit(" vs 候选"), listed(other), F.lit(")"))).otherwise("")
    shown = F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: F.substring(strip(h), 1, 20)), "、")
    return F.concat(scores, classes, F.when(F.size(hits) > 0, F.concat(F.lit(" | 锚点: "), shown)).otherwise(""))


def untraced_evidence(references: Column) -> Column:
    """The best candidates of a unit without relations, as text; ``references`` is an array of doc, key and score."""
    shown = F.array_join(F.transform(references, lambda r: F.concat(r["doc"], F.lit(":"), F.substring(r["key"], 1, 24), F.format_string("(%.2f)", r["score"]))), "; ")
    return F.when(F.size(references) > 0, F.concat(F.lit("UNTRACED | 参考候选: "), shown)).otherwise("UNTRACED")


def page_text(text: Column) -> Column:
    """Text of a page without private signs, gaps between CJK characters, and lone list marks."""
    t = F.regexp_replace(text, PRIVATE_USE, "")
    t = F.regexp_replace(t, rf"(?<=[{CJK}，。；：！？、（）])[ \t]+(?=[{CJK}，。；：！？、（）])", "")
    t = F.regexp_replace(t, r"(?m)^([ \t]*(?:\d+[)）]|[a-zA-Z][)）]))[ \t]+", "$1")
    return F.regexp_replace(t, r"(?m)^[ \t]*[-•●·][ \t]*$\n?", "")


def cell_text(text: Column) -> Column:
    """A table cell: stripped lines without empty ones."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda s: s != ""), "\n")


def is_cjk(character: Column) -> Column:
    return character.rlike(f"^[{CJK}]$")


def forward_title(title: Column) -> Column:
    """A long title cut at its first full stop or colon, else comma, from the 4th to the 12th character, else at the 12th."""
    inside = lambda at: F.when((at > 4) & (at <= 13), at - 1)
    stops = F.least(inside(F.instr(title, "。")), inside(F.instr(title, "：")))
    cut = F.coalesce(stops, inside(F.instr(title, "，")), F.lit(12))
    return F.when(F.length(title) > 12, F.substring(title, F.lit(1), cut)).otherwise(title)


def marker_kind(line: Column) -> Column:
    """What sort of list mark a line has; null without any."""
    kinds = {
        "circled": r"^\s*[①-⑳]",
        "number": r"^\s*(?:\d{1,3}[)）.、]|[(（]\d{1,3}[)）])",
        "chinese": r"^\s*(?:[一二三四五六七八九十]+[、.)）]|[(（][一二三四五六七八九十]+[)）])",
        "letter": r"^\s*(?:[a-zA-Z][)）.]|[(（][a-zA-Z][)）])\s*\S",
        "bullet": r"^\s*[•●·▪■◆○]",
        "dash": r"^\s*[-–—]\s*\S",
    }
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(kinds.items()):
        found = F.when(line.rlike(pattern), kind).otherwise(found)
    return found
