"""spoken numbers, case by case."""

import pytest

from talkframe.functions.numbers import LEXICON, digits

CASES = {
    "two": "2", "thirty one": "31", "five twenty four": "524", "nineteen ninety nine": "1999", "twenty nineteen": "2019",
    "two point five million": "2500000", "four point two billions": "4200000000s", "200 thousand": "200000", "200 thousand dollars": "$200000",
    "$20 million": "$20000000", "€52.4 million": "€52400000", "£77 thousands": "£77000s", "two double o eight": "2008",
    "three thousand twenty nine": "3029", "forty three thousand two hundred sixty": "43260", "forty three thousand two hundred and sixty": "43260",
    "nineteen fifties": "1950s", "thirty first": "31st", "thirty three thousand and three hundred and thirty third": "33333rd",
    "three billion": "3000000000", "millions": "1000000s", "july third twenty twenty": "july 3rd 2020", "august twenty sixth twenty twenty one": "august 26th 2021",
    "3 14": "3 14", "3.14": "3.14", "3 point 2": "3.2", "3 point 14": "3.14", "fourteen point 4": "14.4", "two point two five dollars": "$2.25",
    "two hundred million dollars": "$200000000", "$20.1 million": "$20100000", "ninety percent": "90%", "seventy six per cent": "76%",
    "double oh seven": "007", "double zero seven": "007", "nine one one": "911", "nine double one": "911", "one triple oh one": "10001",
    "two thousandth": "2000th", "thirty two thousandth": "32000th", "minus 500": "-500", "positive twenty thousand": "+20000",
    "two dollars and seventy cents": "$2.70", "two dollars and seven cents": "$2.07", "3 cents": "¢3", "$0.36": "¢36", "three euros and sixty five cents": "€3.65",
    "three and a half million": "3500000", "forty eight and a half dollars": "$48.5", "half and a half": "half and a half", "b747": "b 747", "b2b": "b 2 b", "10 th": "10th", "10th": "10th",
    "o": "0", "hundred": "100", "a hundred": "a 100", "one": "one", "ones": "ones", "1": "one", "1s": "ones", "twenty one": "21", "o one": "01",
    "one decillion": "1" + "0" * 33, "minus the": "minus the", "dollars": "dollars", "per cent": "per cent", "point": "point", "double": "double", "double trouble": "double trouble",
    "and": "and", "two and three": "2 and 3", "one hundred and": "100 and", "two per person": "2 per person", "eighty eighth": "88th", "sixes": "6s", "ninetieth": "90th",
    "192 point 168": "192.168", "one hundred two hundred": "10200", "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_digits(text):
    assert digits(text) == CASES[text]


def test_lexicon():
    assert LEXICON["eighth"] == ("unit", 8, "th") and LEXICON["fourth"] == ("unit", 4, "th") and "fiveth" not in LEXICON and LEXICON["hundredth"] == ("scale", 100, "th")
    assert LEXICON["twenties"] == ("ten", 20, "s") and LEXICON["zeroth"] == ("unit", 0, "th")
