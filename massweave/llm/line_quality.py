"""Operator 2: line-first quality rules.

Every line is judged alone: navigation (bars and arrows between few words, or links and paths in place
of words, in any language), boilerplate (notices of licences, rights, cookies, scripts and accounts
in five languages, or under a rights sign, where the notice's words are at least a fifth of the line: prose that
names one stays), punctuation (symbol or exclamation noise, short lines that end like no sentence) and
repetition (a line seen before, a line of one word over and over). Failing lines go; a document goes
if it loses more than half of its words, or fails the base rules on its whole text. The words
lost by each rule are returned.

Cases: null and empty texts have no words and fail. A line that several rules fail counts for the first
in the order above. Rows are independent, so repeated rows give repeated results. Texts are read
whole; memory is that of a slice of texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import WORD, documents, map_rows

#: A document may lose this share of its words with failing lines.
MAX_LOSS = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

WORDS = re.compile(WORD)
SYMBOL_CHARS = "#*$%&|<>"
SEPARATOR = re.compile(r"[|»«›‹>/·•\\–—-]+")
#: Phrases of notices, by language; a line fails by them only if their words are ``NOTICE_SHARE`` of its words.
NOTICES = {
    "en": "all rights reserved|terms of (?:use|service)|privacy policy|cookies?(?: policy)?|javascript|licen[cs]ed under(?: the)?|general public licen[cs]e|public licen[cs]e|released under(?: the)?|creative commons|click here|read more|sign in|sign up|login|log in|subscribe|share this|powered by",
    "de": "alle rechte vorbehalten|nutzungsbedingungen|datenschutz(?:erklärung)?|impressum|lizenziert unter(?: der)?|hier klicken|weiterlesen|mehr lesen|anmelden|abonnieren|diese seite teilen",
    "fr": "tous droits réservés|conditions d[’']utilisation|politique de confidentialité|mentions légales|sous licence|cliquez ici|lire la suite|se connecter|abonner|partager cette page",
    "es": "todos los derechos reservados|términos de (?:uso|servicio)|política de privacidad|aviso legal|bajo(?: la)? licencia|haga clic aquí|leer más|iniciar sesión|suscríbete|compartir esta página",
    "la": "lorem ipsum",
}
BOILERPLATE = re.compile("(?i)(?<!\\w)(?:" + "|".join(NOTICES.values()) + "|[©®™])(?!\\w)")
NOTICE_SHARE = 0.2
#: How the phrases begin, for a quick look at a whole text.
STEMS = tuple({re.split(r".\?|[(\[]", phrase)[0] for phrases in NOTICES.values() for phrase in re.split(r"\|(?![^(]*\))", phrases)} | {"©", "®", "™"})
LINK = re.compile(r"(?:https?://|www\.|/)[^\s]+")
ENDS = tuple(".!?…:;\"'”’»)]}。！？")
#: A line is noise if this share of its words carry two symbols or exclamation marks, or are bars.
NOISE_SHARE, BAR_SHARE, SHORT_LINE = 0.5, 0.25, 4
NOISY_WORD = re.compile(r"([#*$%&|<>!?])\1")


def notice_share(line: str, n: int) -> float:
    """The notices' words by the line's."""
    return sum(len(WORDS.findall(m[0])) for m in BOILERPLATE.finditer(line)) / n


def line_fails(line: str, words: list[str], notices: bool = True) -> str:
    """The rule that the line fails, or an empty string. ``notices``: whether its text has the beginning of a notice's phrase."""
    n = len(words)
    if any(c in line for c in "|>»·•/\\‹›"):
        if sum(SEPARATOR.fullmatch(w) is not None for w in words) > BAR_SHARE * n or sum(LINK.fullmatch(w) is not None for w in words) > NOISE_SHARE * n:
            return "navigation"
    if notices and BOILERPLATE.search(line) and notice_share(line, n) >= NOTICE_SHARE:
        return "boilerplate"
    if len(NOISY_WORD.findall(line)) > NOISE_SHARE * n or n < SHORT_LINE and not line.rstrip().endswith(ENDS):
        return "punctuation"
    if n > SHORT_LINE and sum(a == b for a, b in zip(words, words[1:])) > NOISE_SHARE * (n - 1):
        return "repetition"
    return ""


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    total, end = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            total += i + window - max(end, i)
            end = i + window
    return total


def judge(text: str | None, max_loss: float = MAX_LOSS) -> tuple:
    """The values of ``SCHEMA`` but the id."""
    text = text or ""
    words = WORDS.findall(text)
    n, n_symbols = len(words), sum(map(text.count, SYMBOL_CHARS))
    seen: set[str] = set()
    dup = 0
    lost = dict.fromkeys(RULES, 0)
    left = []
    low = text.lower()
    notices = any(s in low for s in STEMS)
    for line in text.split("\n"):
        own = WORDS.findall(line)
        if not own:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        rule = line_fails(line, own, notices) or ("repetition" if again else "")
        if rule:
            lost[rule] += len(own)
        else:
            left.append(line)
    again = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    kept = not base_failed and sum(lost.values()) <= max_loss * n
    return n, len("".join(words)), n_symbols, dup, again, base_failed, kept, *lost.values(), "\n".join(left)


RULES = ("navigation", "boilerplate", "punctuation", "repetition")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + "".join(f"lost_{r} long, " for r in RULES) + "cleaned string"


def clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The figures, the verdict, the words lost by rule and the cleaned text of every document."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def task():
        def each(x: dict[str, list]) -> dict:
            rows = [judge(t, max_loss) for t in x["text"]]
            return {"doc_id": x["doc_id"]} | dict(zip(names, zip(*rows) if rows else [()] * len(names)))

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, SCHEMA)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(documents(spark, sf_dir)).drop("cleaned")
