"""French text search: light stemming, query syntax and cover density.

The stemmer is a light one (plural, feminine and common endings, published for French retrieval); it is not the
stemmer of any database, so stemmed matches are this library's own.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words without search value.
STOP = frozenset(
    "à au aux avec ce ces cet cette dans de des du elle elles en et eux il ils je la le les leur leurs lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y est sont était étaient été être suis es sommes êtes ai as a avons avez ont avait avaient".split()
)
_WORD = re.compile(r"[^\W_]+")
_ENDINGS = ("issements", "issement", "atrices", "atrice", "ateurs", "ateur", "logies", "logie", "ements", "ement", "ations", "ation", "ances", "ance", "ences", "ence", "euses", "euse", "ités", "ité", "ives", "ive", "ifs", "if", "ables", "able", "ibles", "ible", "ismes", "isme", "istes", "iste", "antes", "ante", "ants", "ant", "aient", "ions", "ait", "ais", "ées", "ée", "és", "er", "ez", "é")


@lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower()
    if w.endswith("aux") and len(w) > 5:
        w = w[:-2] + "l"
    for e in _ENDINGS:
        if w.endswith(e) and len(w) - len(e) >= 4:
            w = w[: -len(e)]
            break
    else:
        w = w[:-1] if len(w) > 4 and w[-1] in "sx" else w
        w = w[:-1] if len(w) > 4 and w[-1] == "e" else w
    w = re.sub(r"(.)\1$", r"\1", w)
    return w.translate(str.maketrans("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"))


def lexemes(text: str) -> list[tuple[str, int]]:
    """Stems and positions of the words of a text, without stop words."""
    return [(stem(w), i) for i, w in enumerate(_WORD.findall(text.lower())) if w not in STOP]


def parse(query: str) -> list[tuple[str, list[list[str]]]]:
    """Web search syntax: a list of ("and" or "not", alternatives); each alternative is a phrase of stems."""
    out: list[tuple[str, list[list[str]]]] = []
    alternative = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            alternative = bool(out)
            continue
        stems = [s for s, _ in lexemes(phrase or word)]
        if not stems:
            continue
        if alternative and out and not minus:
            out[-1][1].append(stems)
        else:
            out.append(("not" if minus else "and", [stems]))
        alternative = False
    return out


def places(text: str) -> dict[str, set[int]]:
    """The positions of each stem of a text."""
    at: dict[str, set[int]] = {}
    for s, i in lexemes(text):
        at.setdefault(s, set()).add(i)
    return at


def _spots(at: dict[str, set[int]], phrase: list[str]) -> set[int]:
    if len(phrase) == 1:
        return at.get(phrase[0], set())
    return {i for i in at.get(phrase[0], ()) if all(i + k in at.get(p, ()) for k, p in enumerate(phrase))}


def density(at: dict[str, set[int]], wanted: list[tuple[str, list[list[str]]]]) -> float | None:
    """Cover density of a text (its places) for a parsed query, null if it does not match.

    A cover is a shortest stretch with all terms; it counts its terms' weight over 1 plus the words between them.
    """
    if not any(kind == "and" for kind, _ in wanted):
        return None
    groups: list[set[int]] = []
    for kind, alternatives in wanted:
        spots = set().union(*(_spots(at, p) for p in alternatives))
        if kind == "not" and spots or kind == "and" and not spots:
            return None
        if kind == "and":
            groups.append(spots)
    events = sorted((i, g) for g, spots in enumerate(groups) for i in spots)
    last: dict[int, int] = {}
    total, low_before = 0.0, -1
    for i, g in events:
        last[g] = i
        if len(last) == len(groups) and (low := min(last.values())) > low_before:
            total += 0.1 * len(groups) / (len(groups) + max(0, i - low + 1 - len(groups)))
            low_before = low
    return total


def rank(text: str, query: str) -> float | None:
    return density(places(text), parse(query))
