"""Metaphone keys of words (the original rules of 1990)."""

from __future__ import annotations

VOWELS, FRONT = "AEIOU", "EIY"


def metaphone(word: str) -> str:
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    w = "".join(ch for i, ch in enumerate(w) if ch == "C" or i == 0 or ch != w[i - 1])
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    is_vowel = lambda i: at(i) != "" and at(i) in VOWELS
    is_front = lambda i: at(i) != "" and at(i) in FRONT
    key, i = "", 0
    while i < len(w):
        ch, step = w[i], 1
        if ch in VOWELS:
            key += ch if i == 0 else ""
        elif ch == "B":
            key += "" if at(i - 1) == "M" and i == len(w) - 1 else "B"
        elif ch == "C":
            if at(i - 1) == "S" and is_front(i + 1):
                pass
            elif w[i : i + 3] == "CIA":
                key += "X"
            elif is_front(i + 1):
                key += "S"
            elif at(i + 1) == "H":
                key += "K" if at(i - 1) == "S" or (i == 0 and not is_vowel(i + 2)) else "X"
                step = 2
            else:
                key += "K"
        elif ch == "D":
            if at(i + 1) == "G" and is_front(i + 2):
                key += "J"
                step = 2
            else:
                key += "T"
        elif ch == "G":
            if at(i + 1) == "H" and not (i + 2 == len(w) or is_vowel(i + 2)):
                pass
            elif at(i + 1) == "H" and i > 0:
                key += "F" if i + 2 == len(w) else ""
                step = 2
            elif at(i + 1) == "N" and (i + 2 == len(w) or w[i + 2 :] == "ED"):
                pass
            elif at(i - 1) == "D" and is_front(i + 1):
                pass
            else:
                key += "J" if is_front(i + 1) else "K"
        elif ch == "H":
            key += "H" if is_vowel(i + 1) and at(i - 1) not in ("C", "S", "P", "T", "G") else ""
        elif ch == "K":
            key += "" if at(i - 1) == "C" else "K"
        elif ch == "P":
            key += "F" if at(i + 1) == "H" else "P"
        elif ch == "Q":
            key += "K"
        elif ch == "S":
            if at(i + 1) == "H":
                key += "X"
                step = 2
            elif w[i : i + 3] in ("SIO", "SIA"):
                key += "X"
            else:
                key += "S"
        elif ch == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                key += "X"
            elif at(i + 1) == "H":
                key += "0"
                step = 2
            elif w[i : i + 3] != "TCH":
                key += "T"
        elif ch == "V":
            key += "F"
        elif ch in "WY":
            key += ch if is_vowel(i + 1) else ""
        elif ch == "X":
            key += "KS"
        elif ch == "Z":
            key += "S"
        else:  # F J L M N R
            key += ch
        i += step
    return key
