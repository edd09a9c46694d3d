"""The Porter2 (English) stemmer, after its published description."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_R = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = _R.search(w)
        r1 = m.end() if m else len(w)
    m = _R.search(w, r1)
    return r1, m.end() if m else len(w)


def _short(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w.strip()) < 2:
        return word
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.removeprefix("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w
    # 1b
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            if s in ("eedly", "eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, put in sorted([*_STEP2, ("ogi", ""), ("li", "")], key=lambda x: -len(x[0])):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif s == "li":
                    w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + put
            break
    # 3
    for s, put in sorted([*_STEP3, ("ative", "")], key=lambda x: -len(x[0])):
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + put
            break
    # 4
    for s in sorted([*_STEP4, "ion"], key=lambda x: -len(x)):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
