"""Answer texts to choice positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skillgauge.functions.text import WHITESPACE, strip

# The alphabets that label choices, in rank order.
ALPHABETS = {
    "greek": "αβγδεζηθικ",
    "keyboard": "!@#$%^₪*)(",
    "capitals": "ABCDEFGHIJ",
    "lowercase": "abcdefghij",
    "numbers": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10"],
    "roman": ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"],
}
# Lead-ins before a label, in the order they are tried.
LEAD_INS = ["answer: ", "the answer is ", "the correct answer is "]
# Marks that may enclose a one-character label.
QUOTES = ["'", '"', "`"]
# Fixed value: the last position that counts.
LAST_POSITION = 4

_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
_LEAD_IN = "(?i:" + "|".join(LEAD_INS) + ")"
_QUOTE = "[" + "".join(QUOTES) + "]"
# A label that one of `. ) :` and whitespace end.
_LABELLED = rf"(?s)^([^.):]+)[.):]{_SPACE}.*$"
_INTRODUCED = rf"(?s)^{_LEAD_IN}(.*)$"
_QUOTED = rf"(?s)^{_QUOTE}(.){_QUOTE}$"
_INTRODUCED_OR_QUOTED = rf"(?s)^(?:{_LEAD_IN}(.*)|{_QUOTE}(.){_QUOTE})$"


def answer_position(answer: Column, older_rules: bool = False) -> Column:
    """H1: position 1..4 that an answer's leading label names in any alphabet, else null.

    The label ends at the first of `. ) :` when whitespace follows; otherwise the whole answer is the
    label. A lead-in is dropped, or else the quotes around a single character.

    H1b, `older_rules=True`: quotes go after a lead-in too, and the first alphabet that holds the label
    decides, so `I`, the ninth capital, is out of range instead of the first roman number.

    Each step uses the one before exactly once, which keeps the expression small.
    """
    label = strip(F.regexp_replace(strip(answer), _LABELLED, "$1"))
    if older_rules:
        label = F.regexp_replace(strip(F.regexp_replace(label, _INTRODUCED, "$1")), _QUOTED, "$1")
    else:
        label = strip(F.regexp_replace(label, _INTRODUCED_OR_QUOTED, "$1$2"))
    positions: dict[str, int] = {}
    for letters in ALPHABETS.values():
        for position, letter in enumerate(letters, start=1):
            known = letter in positions if older_rules else positions.get(letter, LAST_POSITION + 1) <= LAST_POSITION
            if not known:
                positions[letter] = position
    valid = {letter: position for letter, position in positions.items() if position <= LAST_POSITION}
    table = F.create_map(*[F.lit(value) for entry in valid.items() for value in entry])
    return F.try_element_at(table, label)


def choice_position(answer: Column, choices: Column) -> Column:
    """H2: 1-based position in `choices` of the text after the first `". "`, else null."""
    text = F.when(F.instr(answer, ". ") > 0, F.substring(answer, F.instr(answer, ". ") + 2, F.length(answer)))
    return F.nullif(F.array_position(choices, text), F.lit(0)).cast("int")


def choice_array(
    dataset: Column,
    choices_text: Column,
    endings: Column,
    options: Column,
    choices: Column,
    answers: Column,
) -> Column:
    """H3: the choice list of an example, by dataset family.

    `choices_text` is the nested list, `endings`, `options` and `choices` are flat lists and
    `answers` the list built from three scalar columns.
    """
    return (
        F.when(dataset.startswith("ai2_arc") | dataset.startswith("openbook_qa"), choices_text)
        .when(dataset.startswith("hellaswag"), endings)
        .when(dataset.startswith("mmlu_pro") | dataset.startswith("race"), options)
        .when(dataset.startswith("social_iqa"), answers)
        .when(dataset.startswith("mmlu"), choices)
    )
