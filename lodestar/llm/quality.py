"""Quality rules, line first.

Every line with a word is judged on its own: punctuation rules, navigation rules
and boilerplate rules. Boilerplate is a short line that the document had before, in
whatever language, a shouted one, and one with a phrase of page furniture (fixed
lists for four languages). Lines that fail are removed. A document that loses too
large a share of its words that way is rejected, and so is one that fails the base
rules on the whole text (too few words, or too many words in repeated windows).

At scale: one pass where the rows are read, no shuffle; memory is that of a batch.

Defined cases: a null text has no words, and so fails the base rules; a text
without failing lines is left as it is; null ids, repeated rows and further columns
are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_texts, small_batches, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS = 10
#: Of 100 words, how many may lie in repeated windows.
MOST_REPEATED = 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DECORATED = re.compile(r"[#*$%&<>^~=_]{2,}[.,;:]?(?=[ \t\x0b\x0c\r]|$)|!{2,}[.,;:]?(?=[ \t\x0b\x0c\r]|$)")
_SEPARATOR = re.compile(r"(?:^|[ \t])[|»›•·>/-](?=[ \t]|$)")
#: Fixed phrases of page furniture, in lower case: English, German, French, Spanish.
FURNITURE = (
    "accept cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "sign in to", "skip to content", "subscribe to our", "terms of service", "terms of use", "this site uses cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "aller au contenu",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso", "saltar al contenido",
)


@dataclass(frozen=True)
class LineRules:
    """Shares are of a line's words."""

    most_decorated: float = 0.3
    most_separators: float = 0.2
    most_shouted: float = 0.8
    shouted_from: int = 4
    furniture_to: int = 30
    #: Words up to which a line that the document had before is boilerplate.
    repeated_to: int = 30
    #: Of a document's words, the share that failing lines may hold.
    most_lost: float = 0.5


RULES = LineRules()


def line_failure(line: str, rules: LineRules = RULES) -> str | None:
    """Which rule a line with words fails: punctuation, navigation, boilerplate, or None."""
    n = len(_WORD.findall(line))
    if not n:
        return None
    if len(_DECORATED.findall(line)) > rules.most_decorated * n:
        return "punctuation"
    if n >= 4 and len(_SEPARATOR.findall(line)) >= rules.most_separators * n:
        return "navigation"
    low = line.lower()
    upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
    if n >= rules.shouted_from and upper > rules.most_shouted * (upper + lower):
        return "boilerplate"
    if n <= rules.furniture_to and any(p in low for p in FURNITURE):
        return "boilerplate"
    return None


#: Words from which windows are numbered in arrays; shorter texts are quicker as tuples.
LONG_TEXT = 20_000


def _numbered_windows(words: list, window: int) -> np.ndarray:
    """The same number for the same window: windows of k words are numbered by those of k - 1 and the last word."""
    _, word = np.unique(np.array(list(map({}.setdefault, words, range(len(words)))), np.int64), return_inverse=True)
    out, kinds = word, int(word.max()) + 1
    for k in range(1, window):
        _, out = np.unique(out[:-1] * kinds + word[k:], return_inverse=True)
    return out


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, the first included."""
    if len(words) >= max(LONG_TEXT, window):
        number = _numbered_windows(words, window)
        again = np.bincount(number)[number] > 1
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, np.nonzero(again)[0], 1)
        np.add.at(marks, np.nonzero(again)[0] + window, -1)
        return int((np.cumsum(marks[:-1]) > 0).sum())
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(windows) == len(set(windows)):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def judge(text: str, rules: LineRules = RULES) -> tuple[tuple, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost words) and the cleaned text."""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    own = [x for x in lines if x.strip(SPACES)]
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    bad: dict[str, bool] = {}  # what is said of a line when it comes again
    left: list[str] = []
    lost = 0
    for line in lines:
        if not line or line.isspace() and not line.strip(SPACES):
            left.append(line)
            continue
        fails = bad.get(line)
        if fails is None:
            fails = line_failure(line, rules) is not None
            bad[line] = fails or len(line.encode().split()) <= rules.repeated_to
        if fails:
            lost += len(line.encode().split())
        else:
            left.append(line)
    clean = "\n".join(left) if lost else text
    figures = (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(own) - len(set(own)), repeats, failed, not failed and lost <= rules.most_lost * n, lost)
    return figures, clean


_FIGURES = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lost_words", pa.int64()))


def quality_report(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """A row for each document with its figures and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            rows = list(zip(*(judge(t, rules)[0] for t in arrow_texts(batch, 1)))) or [()] * len(_FIGURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(rows, _FIGURES))], names=["doc_id", *(n for n, _ in _FIGURES)])

    schema = "doc_id long, " + ", ".join(f"{n} {'boolean' if kind == pa.bool_() else 'long'}" for n, kind in _FIGURES)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def clean_documents(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """The kept documents, all columns, without their failing lines."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, where):
            judged = [judge(t, rules) for t in arrow_texts(batch, where)]
            columns = [pa.array([c for _, c in judged], pa.string()) if i == where else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([f[6] for f, _ in judged], pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
