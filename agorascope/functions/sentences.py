"""Sentence splitting for informal Korean text, as an Arrow-batched function.

A sentence ends with a run of closing marks: ! ? ; (but not alone in parentheses), a full stop that neither belongs to
a number nor to an abbreviation with several stops, emoticon letters at a word's end, or line ends after an ending
syllable. Text after the last closing run stays with the last sentence.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of emoticons, and syllables after which a line end closes a sentence.
EMOTICON = "ㅎㅋㄷㅠㅜ^"
ENDING = "요죠듯음다까 "
#: No other sign begins a closing run.
MARK = re.compile("[!?;.\n\r" + re.escape(EMOTICON) + "]")


def stop_closes(t: str, i: int) -> bool:
    """Whether the full stop at i closes a sentence."""
    if i == 0:
        return False
    if i == len(t) - 1:
        return True
    before, after = t[i - 1], t[i + 1]
    kinds = ("d" if before.isdigit() else "s" if before.isspace() else "x") + ("d" if after.isdigit() else "s" if after.isspace() else "x")
    if kinds in ("dd", "sd", "ds"):
        return False
    if "." in (before, after):
        return True
    return "." not in t[max(0, i - 4) : i - 1] and "." not in t[i + 1 : i + 5]


def run_of(t: str, i: int, signs: str) -> int:
    """Where the run of ``signs`` that begins at i ends."""
    return next((k for k in range(i, len(t)) if t[k] not in signs), len(t))


def closing(t: str, i: int, parenthesised: bool) -> int:
    """Where the closing run that begins at i ends; i if none does."""
    c = t[i]
    if c in "!?;":
        alone = parenthesised and 0 < i < len(t) - 2 and t[i - 1] == "(" and t[i + 1] == ")"
        return i if alone else i + 1
    if c == ".":
        return i + stop_closes(t, i)
    if c in EMOTICON and (i + 1 == len(t) or t[i + 1].isspace() or t[i + 1] in EMOTICON):
        return run_of(t, i, EMOTICON)
    if c in "\n\r" and i and t[i - 1] in ENDING:
        return run_of(t, i, "\n\r")
    return i


def split_sentences(text: str | None, parenthesised: bool = True) -> list[str]:
    """``parenthesised``: a mark alone in parentheses closes nothing."""
    t = text or ""
    ends, found = [], MARK.search(t)  # of runs of closing marks
    while found:
        i = found.start()
        end = closing(t, i, parenthesised)
        if end > i:
            if ends and ends[-1] == i:
                ends[-1] = end
            else:
                ends.append(end)
        found = MARK.search(t, max(end, i + 1))
    starts = [0, *ends[:-1], len(t)]
    return [t[a:b].strip() for a, b in zip(starts, starts[1:]) if a < b]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences)
