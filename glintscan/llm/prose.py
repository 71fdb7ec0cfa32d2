"""How likely ordinary text writes a string: words, identifiers and paths of the common European languages.

The model goes from character to character: first the kind of the next one (lower case, upper case, digit, separator), then
which one it is. Letters follow the letter before them, without regard to case; a word starts after anything else and at a
capital after a small letter. Digits are all alike. A string without small letters counts as the same in small ones, for
words are also written in capitals.
"""

from __future__ import annotations

import math

SMALL = "abcdefghijklmnopqrstuvwxyz"
#: Costs in half bits, as digits of base 36, of a to z at the start of a word (first group) and after a, b, ... z. Counted in
#: the message catalogues of 16 languages and in English and source texts, three hundredths shared out evenly.
COSTS = (
    "898789ab9da999a8fa78aacgfd ca99hdaebea686gag686bbefcc 5ccf6fgg6bh6ee7ei7ad7hgi9h 6gbe7fh58e9afg5fi9b7ahijec "
    "6eeb3dfg6gfbec7diaab9efgef ad99ccbebfb7a5fbf567ecfafd 8fec78eh4fi9ff5ej8ba9ihiei 7eed4faa7fgad88di79a7ggiag "
    "4gfd4ghf6eeadd6giad89dgjci ac898b9heea8958cg977ebhdgb 5ffb3ggh8hc8db6dje9c8egjie 5fdf5ged7f89fc6ej9988fejci "
    "5eea4ede5ge7dd7ejga99ehgbg 49fe4ggh6jgc9c77jfbd9fhhei 7f976b7e7fcdeb8eif86achicf cba8edbecfb885b9i5899bbghd "
    "5ece5ffd8jf7ge69i6b99ghjbh cgfefghhdjg9edeefccc1gbiii 6eba4ebe6gccab7eha989cficd 8g9f5efb7g9bee89gf849fgibb "
    "6gde4ega5hfdee7dj7a99ffgaf 99bb8cbh9db776d9j776degfge 4ffg3ghh6jhfdb7hjdcecghgch 4fdc6ffb5iedf97ej99edgfg8g "
    "9c7c5bhd6igcafc6hdc5ddfbaf 7b9b8cddada88995ib76ddcgcd 5ddc4hee6gdcb88difda9ebh9b"
)
#: Chances that a lower case letter, an upper case letter, a digit and a separator follow nothing and each of the four.
KINDS = {"": (0.7, 0.2, 0.06, 0.04), "l": (0.84, 0.05, 0.03, 0.08), "u": (0.4, 0.5, 0.05, 0.05), "d": (0.12, 0.12, 0.6, 0.16), "s": (0.7, 0.15, 0.1, 0.05)}
SEPARATORS = {"/": 0.3, "-": 0.3, "_": 0.38, "+": 0.02}


def letter_logs(costs: str) -> dict[str, dict[str, float]]:
    """Logarithms of the chances of each letter, by the letter before it (``^`` at the start of a word)."""
    out = {}
    for before, row in zip("^" + SMALL, costs.split(), strict=True):
        weights = [2 ** (-int(c, 36) / 2) for c in row]
        out[before] = {c: math.log(w / sum(weights)) for c, w in zip(SMALL, weights, strict=True)}
    return out


LETTER_LOGS = letter_logs(COSTS)
KIND_LOGS = {last: dict(zip("luds", map(math.log, chances), strict=True)) for last, chances in KINDS.items()}
SEPARATOR_LOGS = {c: math.log(chance) for c, chance in SEPARATORS.items()}
DIGIT_LOG = math.log(0.1)


def log_chance(body: str) -> float:
    """Natural logarithm of the chance of a string of letters, digits and ``+/_-``."""
    if body == body.upper():
        body = body.lower()
    total, last, before = 0.0, "", "^"
    for c, small in zip(body, body.lower(), strict=True):
        if c in SEPARATOR_LOGS:
            kind, chance = "s", SEPARATOR_LOGS[c]
        elif small not in LETTER_LOGS:
            kind, chance = "d", DIGIT_LOG
        else:
            kind = "l" if c == small else "u"
            if last not in ("l", "u") or (last == "l" and kind == "u"):
                before = "^"
            chance, before = LETTER_LOGS[before][small], small
        total += KIND_LOGS[last][kind] + chance
        last = kind
    return total
