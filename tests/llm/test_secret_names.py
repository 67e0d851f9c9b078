import itertools

from seqtables.llm import secrets


def test_names_looked_for_first_are_in_every_assignment():
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        for cased in (word, word.upper(), word.title(), word.swapcase(), "".join(c.upper() if i % 2 else c for i, c in enumerate(word))):
            for before, sign in itertools.product(("", "İ", "K", "x"), ("=", ": ", "\"  :  '")):
                text = f"{before}{cased}{sign}Abcdefghijkl-99 and {word}"
                found = [(m.start(), 0, m.end(), m.start(2)) for m in secrets.ASSIGN.finditer(text)]
                assert len(found) == 1 and any(name in text.lower() for name in secrets.NAMES)
                assert secrets.base_spans(text) == found
    assert secrets.base_spans("pass word = abcdefghijklmnop, tok=abcdefghijklmnop") == []
