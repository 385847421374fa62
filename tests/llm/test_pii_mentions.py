"""Later mentions of people, possessives and secrets in other spellings."""

import re

from rollmill.llm import pii


def safe(spark, texts):
    got = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.safe_text for r in sorted(got, key=lambda r: r["__row"].doc_id)]


def test_later_mentions_follow_the_titled_name(spark):
    got = safe(spark, ["Mr John Smith came. Smith said John Smith's and Mr Smith's; Smithson stays. Mrs Smith left.", "Smith and John Smith here, 1", "Mr O'Neil's cat; O'Neil"])
    first, last = re.match(r"Mr (\w+) (\w+) came\.", got[0]).groups()
    assert re.fullmatch(rf"Mr {first} {last} came\. {last} said {first} {last}'s and Mr {last}'s; Smithson stays\. Mrs (\w+) left\.", got[0])
    assert not re.search(r"\bSmith\b|\bJohn\b", got[0])
    assert got[1] == "Smith and John Smith here, 1"  # nobody there is known by a title
    name = re.match(r"Mr (\w+)'s cat; (\w+)$", got[2])
    assert name[1] == name[2] != "O"


def test_secrets_after_words_in_any_case_and_quotes(spark):
    texts = ["API_KEY=Abcdefghijklmn", "Password: correcthorsebattery", '{"api_key": "QwertyuiopAsdf"}', "my Token = 'zyxwvutsrqponm'"]
    for text, got in zip(texts, safe(spark, texts), strict=True):
        secret = re.search(r"[A-Za-z]{14,}", text)[0]
        assert secret not in got and re.sub(r"[A-Za-z]{14,}", "", got) == re.sub(r"[A-Za-z]{14,}", "", text)
