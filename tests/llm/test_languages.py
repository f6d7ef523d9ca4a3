"""Sentence rules of one language don't speak in another."""

from __future__ import annotations

import pytest

from telemill.llm import sentences


@pytest.mark.parametrize(
    "first,second",
    [
        ("She studies modern art.", "The museum is closed."), ("It is No.", "It is."), ("It has vitamin C.", "The next one is D."), ("We met Pedro M.", "Later it won."), ("The next cost p.", "We left."),
        ("They saw the env.", "Nothing else was in it."), ("See the chap.", "He went to it."), ("He said that it was the cap.", "She said no."),
    ],
)
def test_english_words_that_abbreviate_elsewhere(first, second):
    text = f"The start of the text is here. {first} {second}"
    assert [text[a:b] for a, b in sentences.sentences(text)][1:] == [first, second]
    text = f"{first} {second}"
    assert [text[a:b] for a, b in sentences.sentences(text)] == [first, second]


@pytest.mark.parametrize(
    "text",
    [
        "The proof of No. 5 and pp. 3--4 is in the work of J. Smith and A. B. Jones et al. and of Dr. Miller.", "Les résultats des tests dans art. 5 et chap. II sont une base est M. Dupont.",
        "Der Wert ist in Abb. 3 und Nr. 5 die Basis, vgl. Kap. 2, z. B. am 3. Mai.", "Los datos del núm. 4 y las págs. 3 una vez el Sr. López.", "Это см. рис. 5 и т. е. стр. 7 у проф. Иванова.",
    ],
)
def test_abbreviations_of_the_language(text):
    assert sentences.sentences(text) == [(0, len(text))]


def test_language_follows_the_text():
    assert sentences.language_of(" the cat and the dog of that ") == "en" and sentences.language_of(" los datos del mundo y las cosas ") == "es"
    assert sentences.language_of(" der Hund und die Katze ") == "de" and sentences.language_of(" les gens des villes et une idée ") == "fr"
    assert sentences.language_of("") == "latn" and sentences.language_of("Привет, the мир") == "cyrl"
