"""Vocabulary for texts in English, French, German and Spanish.

The domain's own words do not occur in such texts, so these stand in for them in
the registered queries. Patterns are free of look-around and of word-boundary
escapes, and mean the same to every regular-expression engine.
"""


def word(w: str) -> str:
    return rf"(^|[^\p{{L}}]){w}([^\p{{L}}]|$)"


TOPICS = [("en", word("this")), ("fr", word("avec")), ("de", word("und"))]
# a topic that no document has, so that the fallback of scopes is reached
QUESTION_TOPICS = [("en", word("this")), ("fr", word("avec")), ("de", word("und")), ("xx", word("sur"))]
IMPLIED = [("en", word("the")), ("es", word("que")), ("fr", word("les"))]
FAMILIES = {"en": "west", "fr": "south", "es": "south", "de": "west"}
LAW_WORDS = ["the, ", "for", " are "]
CASE_WORDS = ["was", "with", "this", "from", "that"]
SCOPE_WORDS = ["the", "and", "que", "que", "der", "ungen"]
BLOCKED, WARNING = ["onon"], ["tion"]
SCOPE_TOPICS = ["eaux"]
STOP_WORDS = ["the", "and", "that", "for", "was", "with", "this", "are", "from"]
SECTION_REF = "(?:The|Der|La|El|Le) [a-z]{2}"
CLAUSE = r"The [a-z]+|La [a-z]+"
SECTION = r"And [a-z]+|De [a-z]+"
BLOCKS = [("facts", "\nIs |\nDie "), ("opinion", "\nOn |\nLa "), ("ruling", "\nThe |\nEl "), ("statutes", "\nIn |\nDe ")]
FORM_REF = "(?:ing|tion)[a-z]{2}"
YEAR_REF = "[0-9]{4}"
TEXT_PATTERNS = {"en": ["thth", "onth"], "fr": ["eaux"], "de": ["ungen", "heit"]}
MISMATCH = {"en": ["onon", "shsh"], "fr": ["vivi"], "de": ["schsch"]}
QUESTION_MISMATCH = [("oned", ["ingth", "tieser"])]
PATHWAY = {"de": "pf"}
ANCHORS = {"en": ["tion that", "erin"], "fr": ["eau", "oi"], "de": ["keit", "ung und"]}
COURT_MISMATCH = {"en": ["onon"], "de": ["pfpf"]}
COURT_TOPIC_WORDS = {"en": [" the "], "fr": [" les "], "de": [" und "], "es": [" que "]}
OUTCOMES = [("granted", ["onth", "eaux"]), ("denied", ["tion"]), ("remanded", ["ung"]), ("affirmed", ["que"])]
PHRASES = [("tion", ["terms", "of tion"]), ("ung", ["ung law"])]
FACTS = [("tion", None, ["that with from this", "tion ment eaux"]), ("eau", "que", ["dans pour avec elle"])]
FIGURE = (["the", "ing"], ["onth", "ered"])
CHROME = ["ad"]
NOISE = ["Nicht.*?\n", "The .*?\n", "que.*"]
DEICTIC, QUESTION, COMPARE = word("that"), "tion|ung|eau", word("to")
FORMS_ASKED = "ing"
SUBTOPICS = [("thth", "context one"), ("schsch", "context two")]
URL_ALERTS = [("/en/", "Alert"), ("page=", "News Release")]
TEXT_ALERTS = [(["%%%"], "Fee Update"), (["the ", "und "], "Form Update")]
