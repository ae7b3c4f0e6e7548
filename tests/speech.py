"""Direct speech by its definition: the next opening mark, then the nearest thing that ends it."""


def opens_double(text, i):
    before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
    return text[i] == "“" or (text[i] == '"' and (before.isspace() or before in "([{—–-") and not after.isspace())


def opens(text, i):
    return opens_double(text, i) or text[i] == "‘" or (text[i] == "'" and not (i and text[i - 1].isalnum()))


def blank_line(text, i):
    return text[i] == "\n" and text[i + 1 :].lstrip(" \t").startswith("\n")


def speech(text):
    found, at = [], 0
    while first := [i for i in range(at, len(text)) if opens(text, i)][:1]:
        start, rest = first[0], range(first[0] + 1, len(text))
        mark = {"“": "”", "‘": "’"}.get(text[start], text[start])
        anew = [i for i in rest if opens_double(text, i) and (mark == '"' or (mark == "”" and text[i] == "“"))]
        stops = [(i, 0) for i in rest if blank_line(text, i)][:1] + [(i, 0) for i in anew][:1]
        shut = [(i, 1) for i in rest if text[i] == mark and not (mark in "'’" and text[i + 1 : i + 2].isalnum())][:1]
        if not stops + shut:
            return found
        i, own = min(stops + shut)
        found.append((start, i + own))
        at = i + own
    return found
