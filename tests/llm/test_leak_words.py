from parleyspark.llm import leaks as lk


def test_case_of_letters_whose_capitals_look_latin():
    for a, b in (("Как Вам Мой Новый Текст", "как вам мой новый текст"), ("Έτσι Μετά Ζωή Κατά", "έτσι μετά ζωή κατά"), ("Ќ", "ќ"), ("ТЕКСТ", "текст")):
        assert lk.words(a) == lk.words(b) == lk.words(a.upper())
    # capitals of another script in Latin words are still found
    assert lk.words("КEY ΝOTE") == lk.words("key note")
