"""The English stemmer of the Snowball project (Porter's second), from its published description."""

from __future__ import annotations

VOWELS = "aeiouy"
# Words with stems of their own, words that stay, and words that stay once a plural s is off.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Beginnings after which the first region begins.
BEGIN = ("gener", "commun", "arsen")
STEP_2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _after(w: str, at: int) -> int:
    """Where the region begins: after the first other letter that follows a vowel, from `at` on."""
    for i in range(at + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _ends_short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if word in OWN or len(word) <= 2:
        return OWN.get(word, word)
    marked = []
    for i, c in enumerate(word):
        marked.append("Y" if c == "y" and (i == 0 or marked[-1] in VOWELS) else c)
    w = "".join(marked)
    begin = next((b for b in BEGIN if w.startswith(b)), None)
    r1 = len(begin) if begin else _after(w, 0)
    r2 = _after(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    end = next((x for x in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(x)), None)
    if end in ("eedly", "eed"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w.endswith("logi"):
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, new in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Words whose stems a worker remembers.
ROOM = 100_000


class Stems(dict):
    """Words and their stems, kept as long as there is room."""

    def __missing__(self, word: str) -> str:
        s = stem(word)
        if len(self) < ROOM:
            self[word] = s
        return s
