"""Column functions over text: cleaning, quality, numbers, names. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]"

#: Extensions by category, first match wins in this order.
CATEGORIES = {
    "document": "pdf docx doc rtf pptx ppt hwp hwpx",
    "text": "txt md markdown",
    "code": "py js ts java cpp c h cs go rs php rb swift kt scala dart r sql html css jsx tsx vue svelte",
    "config": "json yaml yml xml toml ini cfg conf properties env",
    "data": "csv tsv xlsx xlsm xltx xltm xls",
    "script": "sh bat ps1 zsh fish",
    "log": "log",
    "web": "htm xhtml",
    "image": "jpg jpeg png gif bmp webp",
}


def clean_text(text: Column) -> Column:
    """Three or more line ends with only space between become two; outer space goes."""
    squeezed = F.regexp_replace(text, rf"\n{SPACE}*\n{SPACE}*\n+", "\n\n")
    return F.regexp_replace(squeezed, rf"^{SPACE}+|{SPACE}+$", "")


def clean_code(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"{SPACE}+$", ""), F.lit("\t"), F.lit("    "))


def sanitize(text: Column) -> Column:
    """Without control characters (but tab, line feed, carriage return), private use and non-characters."""
    return F.regexp_replace(text, "[\x00-\x08\x0b\x0c\x0e-\x1f-￾￿]", "")


def is_sufficient(text: Column, least: int = 500, ratio: float = 0.6) -> Column:
    """At least `least` characters, of which `ratio` are word characters."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))
    return (F.length(text) >= least) & (kept >= ratio * F.length(text))


def is_numeric(text: Column) -> Column:
    """Integers, decimals, thousands, percentages and amounts in dollars or won."""
    return F.trim(text).rlike(r"^[-+]?[$₩]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?%?$")


def column_letter(index: Column) -> Column:
    """A, B, ... Z, AA, ... for 1, 2, ...: bijective base 26 of any bigint; none below 1, null for null."""
    n, parts, first, power = index.cast("bigint"), [], 1, 1
    for _ in range(14):
        digit = F.call_function("div", n - first, F.lit(power)) % 26
        parts.append(F.when(n < first, "").otherwise(F.char(digit + 65)))
        power *= 26
        first += power
    return F.concat(*reversed(parts))


def roman(value: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    digits = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, rest = [], value.cast("int")
    for n, mark in digits:
        out.append(F.repeat(F.lit(mark), F.floor(rest / n).cast("int")))
        rest = rest % n
    return F.concat(*out)


def file_size(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    out = F.format_string("%.1f TB", n / 1024**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024**power)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def category(ext: Column) -> Column:
    out = F.lit("unknown")
    for name, names in reversed(CATEGORIES.items()):
        out = F.when(ext.isin(*names.split()), name).otherwise(out)
    return out


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, common entities are resolved, white space is squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, rf"{SPACE}+", " "))


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def page_tag(n: Column) -> Column:
    return F.concat(F.lit("[Page Number: "), n.cast("string"), F.lit("]"))


def metadata_block(fields: dict[str, Column]) -> Column:
    """Tagged block with a line for each field that is not null or empty."""
    lines = [F.when(c.cast("string") != "", F.concat(F.lit(f"  {k}: "), c.cast("string"))) for k, c in fields.items()]
    return F.concat(F.lit("<Document-Metadata>\n"), F.concat_ws("\n", *lines), F.lit("\n</Document-Metadata>"))


#: Fields in the order in which they stand, those that may follow, and their labels by language.
FIELDS = ("title", "subject", "author", "keywords", "comments", "last_saved_by", "create_time", "last_saved_time")
MORE_FIELDS = ("version", "category", "company", "manager", "file_name", "file_size", "encoding", "row_count", "col_count")
LABELS = {
    "en": ("Title", "Subject", "Author", "Keywords", "Comments", "Last Saved By", "Created", "Last Modified", "Version", "Category", "Company", "Manager", "File Name", "File Size", "Encoding", "Row Count", "Column Count"),
    "ko": ("제목", "주제", "작성자", "키워드", "설명", "마지막 수정자", "작성일", "수정일", "버전", "범주", "회사", "관리자", "파일명", "파일 크기", "인코딩", "행 개수", "열 개수"),
}


def shown_time(time: Column, times: str) -> Column:
    """date_format, but years of five digits and more stand without a plus sign."""
    late = F.year(time.cast("timestamp")) > 9999
    return F.when(late, F.date_format(time, times.replace("yyyy", "y"))).otherwise(F.date_format(time, times))


def labelled_metadata(fields: dict[str, Column], language: str = "ko", times: str = "yyyy-MM-dd HH:mm:ss", tag: tuple[str, str] = ("<Document-Metadata>", "</Document-Metadata>")) -> Column:
    """Tagged block of the fields that are there, the usual ones first and in their order, under their labels.

    A field without a label of its own has its name, in words with capitals. Null fields and empty usual ones are left out; without
    any field the block is empty. Columns named …_time are shown as `times` if they are timestamps.
    """
    labels = dict(zip((*FIELDS, *MORE_FIELDS), LABELS[language], strict=True))
    lines = []
    for name in sorted(fields, key=lambda k: FIELDS.index(k) if k in FIELDS else len(FIELDS)):
        value = shown_time(fields[name], times) if name.endswith("_time") else fields[name].cast("string")
        there = value.isNotNull() & (value != "") if name in FIELDS else value.isNotNull()
        lines.append(F.when(there, F.concat(F.lit(f"  {labels.get(name, name.replace('_', ' ').title())}: "), value)))
    body = F.concat_ws("\n", *lines)
    return F.when(body == "", "").otherwise(F.concat(F.lit(tag[0] + "\n"), body, F.lit("\n" + tag[1])))


#: Character classes of the quality score.
PRIVATE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
COMPATIBLE = r"[\x{3200}-\x{33FF}\x{3700}-\x{37FF}]"
BASIC = r"[\s0-9A-Za-z\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}.,;:!?()\[\]{}<>\"'/\\@#$%^&*+=_~`|-]"


def count_of(text: Column, pattern: str) -> Column:
    """How many characters are of a class."""
    return F.regexp_count(text, F.lit(pattern))


def is_fragmented(text: Column) -> Column:
    """At least five lines, half or more of those not blank having three characters or fewer."""
    lines = F.split(text, "\n", -1)
    full = F.filter(F.transform(lines, F.trim), lambda x: x != "")
    short = F.filter(full, lambda x: F.length(x) <= 3)
    return (F.size(lines) >= 5) & (F.size(full) > 0) & (F.size(short) * 2 >= F.size(full))


def quality(text: Column) -> Column:
    """0 to 1: private-use, replacement and compatibility characters and fragmented lines take away; under 10 characters 1."""
    n = F.length(text)
    bad = count_of(text, PRIVATE) * 0.8 + count_of(text, "\ufffd") * 0.9 + count_of(text, COMPATIBLE) * 1.5
    score = 1 - bad / n - F.when(is_fragmented(text), 0.5).otherwise(0.0)
    score = score * (0.5 + count_of(text, BASIC) / n * 0.5)
    return F.when(n < 10, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def needs_ocr(text: Column) -> Column:
    n = F.length(text)
    broken = (count_of(text, PRIVATE) >= n * 0.1) | (count_of(text, COMPATIBLE) >= n * 0.05)
    return (n >= 10) & ((quality(text) < 0.7) | broken | is_fragmented(text))


#: Compatibility characters that stand for others after a conversion, and what they stand for.
COMPATIBILITY = {
    "\u33d9": "(", "\u33da": ")", "\u33db": "[", "\u33dc": "]", "\u33dd": "[", "\u33de": "]",
    "\u3711": "→", "\u36a8": "/", "\u36f3": "→", "\u3689": "+", "\u33ca": "~",
    "\u3431": '"', "\u3432": '"', "\u3433": '"', "\u3434": '"', "\u3443": '"',
}
#: Symbols of which a recognised line may not consist alone, and further lines that are noise.
SYMBOLS = r"""[.,;:!?@#$%^&*()\[\]{}|\\/<>~`'"\-_+=°·•○●□■◇◆△▲▽▼\s]+"""
NOISE = (r"[ri\-—maonutlg\s]+", r"""[0-9"'\[\]()°\s]{1,5}""", r"[A-Za-z\-—\s]{3,}", r"‥+\s*")


def compatible(text: Column) -> Column:
    """Compatibility characters replaced by what they stand for, in one pass."""
    return F.translate(text, "".join(COMPATIBILITY), "".join(COMPATIBILITY.values()))


def recognised(text: Column) -> Column:
    """Recognised text without lines that are noise.

    Lines are trimmed. Blank ones go, those of symbols alone and those of NOISE. Of the others those stay that hold a Korean
    syllable, or three letters or more that are half of the line without spaces, if any of them is a small letter or a word of two or
    more is in capitals.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def stays(x: Column) -> Column:
        noise = (x == "") | x.rlike(f"^{SYMBOLS}$")
        for pattern in NOISE:
            noise |= x.rlike(f"(?i)^{pattern}$")
        letters = F.regexp_count(x, F.lit(r"\p{L}"))
        capitals = x.rlike(r"(^|\s)(?=\S{2})[^\s\p{Ll}]*\p{Lu}[^\s\p{Ll}]*(\s|$)")
        latin = (letters >= 3) & (letters * 2 >= F.length(F.replace(x, F.lit(" "), F.lit("")))) & (capitals | x.rlike(r"\p{Ll}"))
        return ~noise & (x.rlike("[가-힣]") | latin)

    return F.array_join(F.filter(lines, stays), "\n")


def has_header(rows: Column) -> Column:
    """Whether the first of the rows (arrays of cells) is a header: no number in it, and numbers in the second or no cell twice."""
    first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    words = ~F.exists(first, is_numeric)
    return (F.size(rows) >= 2) & words & (F.exists(second, is_numeric) | (F.size(F.array_distinct(first)) == F.size(first)))
