"""Porter stemming for ROUGE-L tokens (a small per-token helper).

Written from the published algorithm (M. F. Porter, "An algorithm for
suffix stripping", 1980), with the variants of the widely used Python
implementation that the ROUGE scorer calls: words of one or two letters are
kept, a short table of irregular forms, ``-ies``/``-ied`` on four-letter
words, ``y -> i`` only after a consonant, the ``bli``/``alli``/``fulli``/
``logi`` step-2 rules, and a two-letter word counting as consonant-vowel-
consonant-like ending.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms mapped directly to their stem.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    """Is w[i] a consonant (``y`` is one when it follows a vowel or starts the word)."""
    c = w[i]
    if c in VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Porter's measure: number of vowel-consonant sequences."""
    n, prev_vowel = 0, False
    for i in range(len(stem)):
        is_c = _cons(stem, i)
        if is_c and prev_vowel:
            n += 1
        prev_vowel = not is_c
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3:
        return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
                and w[-1] not in "wxy")
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _rules(w: str, rules) -> str:
    """First rule whose suffix ends ``w`` decides: replace when its condition
    holds on the stem, else keep ``w`` (later rules are not tried)."""
    for suffix, repl, cond in rules:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + repl if cond is None or cond(stem) else w
    return w


def _step1(w: str) -> str:
    # 1a: plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-3] + "ie"
    else:
        w = _rules(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)])
    # 1b: past tense and gerund
    if w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                s = w[: -len(suffix)]
                if s.endswith(("at", "bl", "iz")):
                    w = s + "e"
                elif _double_cons(s) and s[-1] not in "lsz":
                    w = s[:-1]
                elif _m(s) == 1 and _cvc(s):
                    w = s + "e"
                else:
                    w = s
                break
    # 1c: y -> i after a consonant (the stem keeps at least two letters)
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        w = w[:-1] + "i"
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
          "ate", "iti", "ous", "ive", "ize"]


def _step2(w: str) -> str:
    # "alli" first; on success the result goes through step 2 again
    if w.endswith("alli") and _m(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    pos = lambda s: _m(s) > 0
    rules = [(s, r, pos) for s, r in _STEP2]
    # "logi" -> "log": the measure is taken with the "l" on the stem
    rules.append(("logi", "log", lambda s: _m(w[:-3]) > 0))
    return _rules(w, rules)


def _step3(w: str) -> str:
    return _rules(w, [(s, r, lambda st: _m(st) > 0) for s, r in _STEP3])


def _step4(w: str) -> str:
    def cond(suffix):
        if suffix == "ion":
            return lambda st: _m(st) > 1 and st[-1:] in ("s", "t")
        return lambda st: _m(st) > 1
    return _rules(w, [(s, "", cond(s)) for s in _STEP4])


def _step5(w: str) -> str:
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=65536)
def porter_stem(word: str) -> str:
    """Stem of one lower-case word."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    return _step5(_step4(_step3(_step2(_step1(w)))))
