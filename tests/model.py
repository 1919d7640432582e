"""Plain-Python models of the line detectors, written from their definition."""

import re
from datetime import datetime

EPOCH = datetime(1970, 1, 1)
ISO = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?")
WORDS = {"TRACE": 1, "DEBUG": 2, "INFO": 3, "WARN": 4, "WARNING": 4, "ERROR": 5, "FATAL": 6}


def moment(year, month, day, hour, minute, second, millis=0):
    if millis > 999 or second > 59:
        return None
    try:
        at = datetime(year, month, day, hour, minute, second)
    except ValueError:
        return None
    return int((at - EPOCH).total_seconds()) * 1000 + millis


def whole_number(text):
    text = text.strip(" ")
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else None  # "-0" is a number


def detect_ms(line):
    found = ISO.search(line)
    if found:
        parts = [int(p) for p in found.groups(default="0")]
        return moment(*parts)
    if len(line) < 19 or line[10] != " " or line[13] != ":" or line[16] != ":" or line[2] != line[5]:
        return None
    orders = {"/": ((0, 3), (3, 0)), ".": ((0, 3),)}.get(line[2], ())
    clock = [whole_number(line[i : i + 2]) for i in (11, 14, 17)]
    for day_at, month_at in orders:
        date = [whole_number(line[6:10]), whole_number(line[month_at : month_at + 2]), whole_number(line[day_at : day_at + 2])]
        if None in date + clock:
            continue
        found = moment(*date, *clock)
        if found is not None:
            return found
    return None


def detect_level(line):
    for word in re.finditer(r"[A-Za-z0-9_]+", line):
        # Case is folded for ASCII letters only.
        if word.group().isascii() and word.group().upper() in WORDS:
            return WORDS[word.group().upper()]
    return 0


def group(lines):
    """(logical_id, ts_ms, level) of each line of one file."""
    out, number, ts, level = [], -1, None, 0
    for line in lines:
        ms, lv = detect_ms(line), detect_level(line)
        if ms is not None and lv:
            number, ts, level = number + 1, ms, lv
        elif number < 0:
            number = 0
        out.append((number, ts, level))
    return out
