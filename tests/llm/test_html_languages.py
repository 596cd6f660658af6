"""op9: pages without an article in languages whose stop words are not known."""

import pytest

from talkframe.llm import html_text

POLISH = "Wczoraj wieczorem mieszkańcy miasta spotkali się przed ratuszem, żeby porozmawiać o nowej drodze przez park. " * 3
RUSSIAN = "Вчера вечером жители города собрались перед ратушей, чтобы обсудить новую дорогу через парк. " * 3
JAPANESE = "昨夜、市民は市役所の前に集まり、公園を通る新しい道路について話し合いました。" * 8


@pytest.mark.parametrize("body", [POLISH, RUSSIAN, JAPANESE])
def test_other_languages(body):
    page = f"<body><nav>Menu</nav><div>{body}</div><div><a href=x>{body}</a></div></body>"
    assert html_text.main_text(page) == body.strip()


def test_known_language_still_judges():
    body = "the cat is on the mat and it was a good day for all of us in the house " * 4
    junk = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega " * 4
    assert html_text.main_text(f"<body><div>{body}</div><div>{junk}</div></body>") == body.strip()
