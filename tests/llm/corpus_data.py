import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {"en": "the of and tion ing with for this that was ner ha thou ble re".split(), "de": "der die und keit ung schaft über für ein lich heit zu ß ä".split(), "fr": "le la des ment eux être où ç é tion aire vous que ai".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = ["".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ". ", "\n"]) for w in words)
