"""Spreadsheet display formats: what a cell shows for its value and format code."""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format codes of the built-in numbers, weekday names.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "yyyy-mm-dd", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "yyyy-mm-dd h:mm", 37: "#,##0;(#,##0)", 38: "#,##0;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 49: "@"}
DAYS_KO = "월화수목금토일"
TOKEN = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[(h+|m+|s+)\]|\[\$([^\]-]*)[^\]]*\]|\[[^\]]*\]|(AM/PM|A/P)|(y+|m+|d+|h+|s+|a{3,4})|(\.0+)|(.)', re.I | re.S)


def bare(code: str) -> str:
    """The code without literals, escapes and brackets, elapsed-time brackets excepted."""
    return re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code, flags=re.I)


def is_date(code: str | None) -> bool:
    left = bare((code or "").split(";")[0])
    return left.lower() != "general" and bool(re.search(r"[ymdhs]", left, re.I)) and not re.search(r"[0#?](?![.\d]*$)", re.sub(r"\.0+", "", left))


def general(value: float) -> str:
    """A number as a cell without a format shows it: 15 digits at most."""
    if float(value).is_integer() and abs(value) < 1e15:
        return str(int(value))
    text = f"{value:.15g}"
    return re.sub(r"e([+-])0*(\d+)", lambda m: f"E{m[1]}{int(m[2]):02d}", text)


def moment(value: float, epoch_1904: bool = False) -> dt.datetime:
    base = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
    return base + dt.timedelta(seconds=round(float(value) * 86400))


def _date(value, code: str, epoch_1904: bool) -> str:
    if isinstance(value, dt.time):
        at, days = dt.datetime.combine(dt.date(1899, 12, 30), value), 0.0
    elif isinstance(value, dt.datetime):
        at = value
        days = (value - dt.datetime(1899, 12, 30)).total_seconds() / 86400
    elif isinstance(value, dt.date):
        at, days = dt.datetime.combine(value, dt.time()), 0.0
    else:
        at, days = moment(value, epoch_1904), float(value)
    found = list(TOKEN.finditer(code))
    half = any(m[7] for m in found)
    kinds = [(m[8] or m[5] or "").lower()[:1] for m in found]
    out = []
    for i, m in enumerate(found):
        if m[1] is not None or m[2]:
            out.append(m[1] if m[1] is not None else m[2])
        elif m[5]:
            out.append(str(int(round(days * 86400) // {"h": 3600, "m": 60, "s": 1}[m[5][0].lower()])))
        elif m[7]:
            out.append("AM" if at.hour < 12 else "PM")
        elif m[8]:
            name, n = m[8].lower()[0], len(m[8])
            before = next((k for k in reversed(kinds[:i]) if k), "")
            after = next((k for k in kinds[i + 1 :] if k), "")
            if name == "m" and n <= 2 and (before == "h" or after == "s"):
                out.append(f"{at.minute:0{n}d}")
            elif name == "m":
                out.append(f"{at.month:0{n}d}" if n <= 2 else at.strftime("%b" if n == 3 else "%B"))
            elif name == "y":
                out.append(f"{at.year:04d}" if n > 2 else f"{at.year % 100:02d}")
            elif name == "d":
                out.append(f"{at.day:0{n}d}" if n <= 2 else at.strftime("%a" if n == 3 else "%A"))
            elif name == "a":
                out.append(DAYS_KO[at.weekday()] + ("요일" if n > 3 else ""))
            else:
                number = (at.hour % 12 or 12) if name == "h" and half else at.hour if name == "h" else at.second
                out.append(f"{number:0{min(n, 2)}d}")
        elif m[10] and not m[10].isspace():
            out.append("" if m[10] in "@;" else m[10])
        elif m[10]:
            out.append(m[10])
    return "".join(out).strip()


def _number(value: float, code: str) -> str:
    shape = bare(code)
    spots = re.search(r"[0#?][0#?,.]*(?:E[+-]0+)?", shape)
    number = Decimal(repr(float(value)))
    if "%" in shape:
        number *= 100
    if not spots:
        body = "" if "@" not in shape else general(value)
    else:
        pattern = spots[0]
        scale = len(pattern) - len(pattern.rstrip(","))
        number /= Decimal(1000) ** scale
        pattern = pattern.rstrip(",")
        whole, _, part = pattern.partition(".")
        if "E" in pattern:
            mantissa, exponent = re.split(r"E[+-]", pattern)
            places = len(mantissa.partition(".")[2])
            text = f"{number:.{places}E}"
            head, tail = text.split("E")
            body = f"{head}E{tail[0]}{int(tail[1:]):0{len(exponent)}d}"
        else:
            least = part.count("0")
            fixed = number.quantize(Decimal(1).scaleb(-len(part)), rounding=ROUND_HALF_UP)
            digits, _, rest = f"{abs(fixed):f}".partition(".")
            while len(rest) > least and rest.endswith("0"):
                rest = rest[:-1]
            digits = digits.zfill(whole.count("0")) if digits != "0" or "0" in whole else ""
            digits = f"{int(digits):,}".rjust(0) if "," in whole and digits and whole.count("0") <= 1 else digits
            body = ("-" if fixed < 0 else "") + digits + (f".{rest}" if rest else "")
    out, done = [], False
    for m in re.finditer(r'"([^"]*)"|\\(.)|_.|\*.|\[\$([^\]-]*)[^\]]*\]|\[[^\]]*\]|[0#?][0#?,.]*(?:E[+-]0+)?|@|(.)', code, re.S):
        literal = m[1] if m[1] is not None else m[2] or m[3] or m[4]
        if literal is not None:
            out.append(literal)
        elif m[0][0] in "0#?@" and not done:
            out.append(body)
            done = True
    return "".join(out).strip()


def shown(value, code: str | None, epoch_1904: bool = False) -> str:
    """What a cell shows; a value that doesn't fit its format is shown plainly. Null: empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return value
    try:
        if is_date(code) or isinstance(value, (dt.date, dt.time)):
            return _date(value, (code or "yyyy-mm-dd").split(";")[0], epoch_1904)
        if not code or code.lower() == "general" or code == "@":
            return general(value)
        parts = re.findall(r'(?:"[^"]*"|\\.|[^;"\\])+', code)
        if value < 0 and len(parts) > 1:
            return _number(-value, parts[1])
        if value == 0 and len(parts) > 2:
            return _number(value, parts[2])
        return _number(value, parts[0])
    except (InvalidOperation, OverflowError, ValueError, IndexError):
        return general(value) if isinstance(value, (int, float)) else str(value)


def format_cell(value: Column, code: Column) -> Column:
    """Display text of numbers by their format codes, in Arrow batches."""

    @F.pandas_udf("string")
    def each(values: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else shown(float(v), c) for v, c in zip(values, codes, strict=True)], dtype=object)

    return each(value.cast("double"), code)
