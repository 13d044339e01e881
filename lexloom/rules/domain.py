"""Default vocabularies of the immigration-research domain.

Everything in this file is a *fixed value*: word lists, lookup tables,
patterns, weights and limits that results depend on. They are plain data; all
logic lives in ``functions`` and ``operators``, which take any of these as a
parameter. Order matters wherever a comment says so.

Patterns are Java regular expressions. ``(?iU)`` makes matching case-insensitive
and Unicode-aware.
"""

I = "(?iU)"

# --- fixed values: topic detection (ordered, first match wins) ---------------
CORPUS_TOPIC_PATTERNS = [
    ("h1b", r"\bh[-\s]?1b\b"),
    ("h4", r"\bh[-\s]?4\b"),
    ("h4_ead", r"\bh[-\s]?4\s*ead\b"),
    ("l1", r"\bl[-\s]?1[ab]?\b"),
    ("o1", r"\bo[-\s]?1\b"),
    ("eb1", r"\beb[-\s]?1\b"),
    ("eb2", r"\beb[-\s]?2\b"),
    ("asylum", r"\basylum\b"),
    ("green_card", r"\bgreen\s*card\b|\blawful permanent resident\b"),
    ("f1", r"\bf[-\s]?1\b"),
]
# The question and chunk detectors know "green card" only in its short form.
QUERY_TOPIC_PATTERNS = [
    (t, r"\bgreen\s*card\b" if t == "green_card" else p) for t, p in CORPUS_TOPIC_PATTERNS
]
# Session tracking tests the longer code first.
SESSION_TOPIC_PATTERNS = [
    ("h4_ead", r"\bh[-\s]?4\s*ead\b"),
    ("h4", r"\bh[-\s]?4\b"),
    ("h1b", r"\bh[-\s]?1b\b"),
    ("l1", r"\bl[-\s]?1[ab]?\b"),
    ("o1", r"\bo[-\s]?1\b"),
    ("eb1", r"\beb[-\s]?1\b"),
    ("eb2", r"\beb[-\s]?2\b"),
    ("f1", r"\bf[-\s]?1\b"),
    ("asylum", r"\basylum\b"),
    ("green_card", r"\bgreen\s*card\b"),
]
# Topic implied by vocabulary when no code is written out (ordered).
IMPLIED_TOPIC_PATTERNS = [
    ("h1b", r"\b(cap|lottery|premium\s+processing|lca)\b"),
    ("f1", r"\b(opt\b|stem\s+opt|curricular\s+practical)"),
    ("eb2", r"\bperm\b|labor\s+certification"),
    ("h4_ead", r"\b(ead|work\s+auth|employment\s+authorization)\b"),
]
TOPIC_FAMILIES = {
    "h1b": "h1b", "h4": "h4", "h4_ead": "h4", "l1": "l1", "o1": "o1",
    "eb1": "eb", "eb2": "eb", "eb3": "eb", "f1": "f1", "asylum": "asylum",
    "green_card": "gc",
}

# --- fixed values: document classification -----------------------------------
LAW_KEYWORDS = [
    "section", "clause", "policy", "regulation", "federal register",
    "uscis", "department of homeland security", "8 c.f.r",
    "immigration and nationality act", "effective date", "final rule",
]
CASE_KEYWORDS = [
    "petitioner", "respondent", "docket", "circuit", "court",
    "held", "ruling", "opinion", "judge", "appeal", "denied",
    "approved", "remanded", "matter of", "in re", "v.",
    "board of immigration appeals", "bia",
]
TRUSTED_LAW_SOURCE = "uscis_policy"
CLASSIFY_SAMPLE_CHARS = 3000
TOPIC_SAMPLE_CHARS = 5000

# --- fixed values: structure markers -----------------------------------------
CLAUSE_MARKER = r"Clause\s+\d+[\.\d]*|§\s*\d+[\.\d]*"
SECTION_MARKER = r"Section\s+\d+[\.\d]*"
SECTION_REF = (
    r"Section\s+\d+[\.\d]*(?:,\s*Clause\s+\d+[\.\d]*)?|§\s*\d+[\.\d]*(?:\([a-z]\))?"
)
FORM_REF = r"\bI-\d{3,4}\b"
YEAR_REF = r"\b(?:19|20)\d{2}\b"
CASE_BLOCK_MARKERS = [
    ("facts", "FACTS|BACKGROUND|STATEMENT OF FACTS"),
    ("opinion", "OPINION|ANALYSIS|DISCUSSION"),
    ("ruling", "RULING|DECISION|HELD|HOLDING|ORDER"),
    ("statutes", "CITED|REFERENCES|STATUTES CITED|AUTHORITIES"),
]
LAW_CHUNK_TOKENS = 512
CASE_CHUNK_TOKENS = 768
CHARS_PER_TOKEN = 4
MIN_CHUNK_CHARS = 50
MIN_PARAGRAPH_CHARS = 100
MIN_PAGE_CHARS = 20
MIN_ARTICLE_CHARS = 100
MIN_CHAPTER_CHARS = 200
MIN_CHARS = {"chunk": MIN_CHUNK_CHARS, "page": MIN_PAGE_CHARS, "article": MIN_ARTICLE_CHARS, "chapter": MIN_CHAPTER_CHARS}
HEADER_KEYS = [
    "title", "source", "url", "doc_type", "visa_type", "source_url",
    "policy_volume", "policy_part", "policy_chapter", "policy_title",
]
HEADER_MAX_LINES = 30
STORED_WIDTHS = {"text": 65000, "section": 190, "clause": 190, "topic": 90, "doc_version": 40}

# --- fixed values: personal data (applied in this order) ---------------------
PII_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE", r"\b(\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"),
    ("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b"),
    ("ALIEN_NUMBER", r"(?i)\bA[-\s]?\d{8,9}\b"),
    ("DATE_OF_BIRTH", r"\b(0?[1-9]|1[0-2])[\/\-](0?[1-9]|[12]\d|3[01])[\/\-](19|20)\d{2}\b"),
    ("ZIP_CODE", r"\b\d{5}(?:-\d{4})?\b"),
]
PII_PHRASES = [
    "ssn", "social security", "passport", "date of birth",
    "my name is", "born on", "alien number", "a-number",
]

# --- fixed values: moderation ------------------------------------------------
# A list, not a set: a term given twice counts twice.
SCOPE_KEYWORDS = [
    "visa", "immigration", "uscis", "petition", "asylum", "green card",
    "work permit", "ead", "i-140", "i-485", "i-765", "i-131", "i-20", "i-94",
    "h1b", "h4", "l1", "o1", "eb1", "eb2", "f1", "b1", "b2", "j1", "tn",
    "naturalization", "citizenship", "deportation", "removal",
    "appeal", "denial", "approval", "case", "filing", "form",
    "policy", "regulation", "section", "clause", "law", "rule",
    "attorney", "lawyer", "client", "firm", "hearing", "court",
    "dependent", "spouse", "employer", "employee", "petition",
    "priority date", "labor certification", "perm", "ac21",
    "portability", "extension", "renewal", "status", "overstay",
    "cap", "lottery", "quota", "nonimmigrant", "beneficiary",
    "opt", "stem opt", "cpt", "sevis", "dso", "practical training",
    "curricular practical", "optional practical", "student visa",
    "stem degree", "grace period",
]
SCOPE_TOPIC_PATTERNS = [
    r"\b(opt\b|stem\s+opt|cpt\b|curricular\s+practical)",
    r"\b(cap|lottery|lca\b|premium\s+processing)",
    r"\b(ead|work\s+auth|employment\s+authorization)",
    r"\b(adjustment\s+of\s+status|consular\s+processing)",
    r"\b(i-140|i-485|i-765|i-129|i-539|i-20|i-94)\b",
    r"\b(h[-\s]?1b|h[-\s]?4|l[-\s]?1|o[-\s]?1|eb[-\s]?[12]|f[-\s]?1)\b",
]
CODE_SPELLINGS = [
    (r"\bh[-\s]?1b\b", "h1b"), (r"\bh[-\s]?4\b", "h4"), (r"\bl[-\s]?1[ab]?\b", "l1"),
    (r"\bo[-\s]?1\b", "o1"), (r"\beb[-\s]?1\b", "eb1"), (r"\beb[-\s]?2\b", "eb2"),
    (r"\bf[-\s]?1\b", "f1"), (r"\bb[-\s]?1\b", "b1"), (r"\bb[-\s]?2\b", "b2"),
]
BLOCKED_PATTERNS = [
    r"\b(ignore|forget|override)\s+(your\s+)?(instructions|rules|guidelines|system\s+prompt)\b",
    r"\b(jailbreak|bypass|hack|exploit)\b",
    r"\b(pretend|act as|you are now|roleplay as)\b",
    r"\b(bomb|weapon|kill|murder|terrorist)\b",
    r"(```|<script|<\/script|SELECT\s+\*\s+FROM)",
]
WARNING_PATTERNS = [
    r"\b(ssn|social security|passport number|alien number)\b",
    r"\b(confidential|private|secret)\b",
]
MODERATION_REASONS = {
    "empty": "Empty query",
    "blocked": "Query contains prohibited content",
    "scope": (
        "This tool is specialized for US immigration law. "
        "Please ask questions related to visas, USCIS policies, "
        "or immigration cases."
    ),
    "warning": "Query contains sensitive terms — proceed with caution",
}
SHORT_QUERY_WORDS = 6

# --- fixed values: answers ---------------------------------------------------
DISCLAIMER = (
    "\n\n---\n"
    "⚠️ **Disclaimer:** This response is generated by an AI research assistant "
    "and is intended for informational purposes only. It does not constitute "
    "legal advice. Always consult a qualified immigration attorney before "
    "making any legal decisions."
)
# (pattern, replacement), applied in order after redaction
ANSWER_REPAIRS = [
    (r"\bcertain\s+\[REDACTED-[A-Z_]+\]", "certain applicants"),
    (r"\beligible\s+\[REDACTED-[A-Z_]+\]", "eligible applicants"),
    (r"\bprove your\s+\[REDACTED-[A-Z_]+\]", "prove your identity"),
    (r"\bprove your the applicant\b", "prove your identity"),
    (r"\bthe\s+\[REDACTED-[A-Z_]+\]", "the applicant"),
    (r"\ban\s+\[REDACTED-[A-Z_]+\]", "the applicant"),
    (r"\ba\s+\[REDACTED-[A-Z_]+\]", "the applicant"),
    (r"\[REDACTED-[A-Z_]+\]", "the applicant"),
]
ANSWER_LABEL_REMOVALS = [
    r"\[LAW\s+\d+\]", r"\[CASE\s+\d+\]", r"\[COURT\s+\d+\]",
    r"\(LAW\s+\d+\)", r"\(CASE\s+\d+\)", r"\(COURT\s+\d+\)",
    r",?\s*LAW\s+\d+", r",?\s*CASE\s+\d+", r",?\s*COURT\s+\d+",
]
ANSWER_PUNCTUATION = [
    (r"\(\s*,\s*\)", ""), (r"\(\s*\)", ""), (r",\s*\)", ")"), (r"\(\s*,", "("),
    (r"  +", " "), (r" \.", "."), (r" ,", ","),
]
# section name -> (header pattern, headers that end the section)
ANSWER_SECTIONS = [
    ("answer", r"\*\*ANSWER:\*\*", [r"\*\*CITED LAWS:\*\*", r"\*\*CITED CASES:\*\*", r"\*\*IMPORTANT NOTES:\*\*"]),
    ("cited_laws", r"\*\*CITED LAWS:\*\*", [r"\*\*CITED CASES:\*\*", r"\*\*IMPORTANT NOTES:\*\*", r"\*\*ANSWER:\*\*"]),
    ("cited_cases", r"\*\*CITED CASES:\*\*", [r"\*\*CITED LAWS:\*\*", r"\*\*IMPORTANT NOTES:\*\*", r"\*\*ANSWER:\*\*"]),
    ("important_notes", r"\*\*IMPORTANT NOTES:\*\*", [r"\*\*NEXT STEPS:\*\*", r"\*\*RISKS", r"\*\*RELATED FORMS:\*\*", r"\*\*ANSWER:\*\*"]),
    ("next_steps", r"\*\*NEXT STEPS:\*\*", [r"\*\*RISKS", r"\*\*RELATED FORMS:\*\*"]),
    ("risks", r"\*\*RISKS(?:\s*&\s*CONSIDERATIONS)?:\*\*", [r"\*\*RELATED FORMS:\*\*"]),
    ("related_forms", r"\*\*RELATED FORMS:\*\*", []),
]
EMPTY_ANSWER = "I was unable to generate a response. Please try again."
EMPTY_ANSWER_NOTE = "Response generation failed — please retry"

QUALITY_GAPS = {
    "no_steps": "Next steps section missing — define client/employer follow-up actions.",
    "few_steps": "Next steps may be incomplete — confirm all filing and verification tasks.",
    "no_risks": "Risks & considerations not listed — review denial scenarios and deadlines manually.",
    "no_forms": "Related forms not listed — verify standard USCIS forms for {topic}.",
    "no_notes": "No important notes/caveats captured — verify date-sensitive policy manually.",
    "no_laws": "No law/policy sources retrieved — answer may rely on limited context.",
    "no_cases": "No case precedents retrieved — confirm whether case law is relevant.",
    "fact": "Answer may not fully cover: {fact}.",
    "figure": (
        "Standard H-1B cap figures (65,000 regular + 20,000 master's cap) "
        "not clearly stated — verify on USCIS H-1B cap season page."
    ),
    "malformed": "Response format was incomplete — verify all sections in source material.",
}
# (question pattern, topic pattern or None, facts expected in the answer)
FACT_CHECKS = [
    (r"\b(cap|lottery|registration)\b", r"\bh[-\s]?1b\b", [
        "annual numerical cap (65,000 regular + 20,000 master's exemption)",
        "electronic registration period and fee",
        "selection/lottery process (including any wage-weighting if applicable)",
        "petition filing window after selection",
        "earliest employment start date (typically October 1 of the fiscal year)",
    ]),
    (r"\b(eligib|require|qualif)\b", r"\b(ead|work\s+auth|employment\s+auth)\b", [
        "eligibility criteria (who qualifies)",
        "required forms and filing category",
        "supporting evidence typically required",
        "timing restrictions or dependencies on principal's status",
    ]),
    (r"\b(compare|difference|vs\.?|versus)\b", None, [
        "side-by-side comparison of eligibility",
        "key procedural differences",
        "employer/sponsor requirements for each option",
    ]),
]
# (question patterns that must all match, figures of which one must appear)
FIGURE_CHECK = ([r"\bh[-\s]?1b\b", r"\b(cap|lottery)\b"], ["65000", "65 000"])
GAP_WEIGHT, GAP_CAP, MALFORMED_PENALTY = "0.08", "0.5", "0.2"
CONFIDENCE_WEIGHTS = {
    "law": ("0.10", 6), "case": ("0.07", 5), "court": ("0.06", 3),
    "well_formed": "0.20", "two_laws": "0.10", "any_case": "0.08",
    "completeness": "0.15", "gap": ("0.04", "0.20"),
}
CONFIDENCE_BANDS = [
    ("high", "0.72", "High confidence"),
    ("medium", "0.45", "Moderate confidence — verify noted gaps"),
    ("low", "0", "Limited sources — attorney review required"),
]
EVAL_BANDS = [("EXCELLENT", "0.80"), ("GOOD", "0.70"), ("ACCEPTABLE", "0.60"), ("NEEDS IMPROVEMENT", "-1")]

# --- fixed values: forms per topic (ordered) ---------------------------------
TOPIC_FORMS = [
    ("h1b", 1, "I-129", "Petition for Nonimmigrant Worker (cap-subject)"),
    ("h1b", 2, "G-28", "Notice of Entry of Appearance as Attorney"),
    ("h1b", 3, "I-797", "Notice of Action"),
    ("h4", 1, "I-539", "Application to Extend/Change Status"),
    ("h4", 2, "I-765", "Application for Employment Authorization"),
    ("h4_ead", 1, "I-765", "Application for Employment Authorization (EAD)"),
    ("h4_ead", 2, "I-539", "Application to Extend/Change Status"),
    ("l1", 1, "I-129", "Petition for L-1 Intracompany Transferee"),
    ("o1", 1, "I-129", "Petition for O-1 Extraordinary Ability"),
    ("eb1", 1, "I-140", "Immigrant Petition for Alien Worker"),
    ("eb2", 1, "I-140", "Immigrant Petition for Alien Worker"),
    ("asylum", 1, "I-589", "Application for Asylum"),
    ("asylum", 2, "I-765", "EAD (if eligible)"),
    ("green_card", 1, "I-485", "Application to Register Permanent Residence"),
    ("green_card", 2, "I-693", "Report of Medical Examination"),
    ("f1", 1, "I-20", "Certificate of Eligibility (SEVIS)"),
    ("f1", 2, "I-765", "OPT Employment Authorization"),
]

# --- fixed values: passage relevance -----------------------------------------
RELEVANCE_STOP_WORDS = [
    "what", "are", "the", "for", "how", "to", "is", "a", "an", "can", "do",
    "long", "much", "many", "does", "did", "have", "has", "been", "being",
    "requirements", "explain", "tell", "about", "please", "help", "need",
    "that", "this", "with", "from", "when", "where", "which", "who", "why",
]
TOPIC_TEXT_PATTERNS = {
    "h1b": [r"\bh-?1b\b", r"specialty\s+occupation", r"\blca\b"],
    "h4": [r"\bh-?4\b", r"dependent\s+spouse"],
    "h4_ead": [r"\bh-?4\b", r"\bead\b", r"employment\s+authorization", r"i-765", r"\(c\)\(26\)"],
    "l1": [r"\bl-?1[ab]?\b", r"intracompany"],
    "o1": [r"\bo-?1\b", r"extraordinary\s+ability"],
    "eb1": [r"\beb-?1\b", r"priority\s+worker"],
    "eb2": [r"\beb-?2\b", r"\bperm\b", r"labor\s+certification"],
    "asylum": [r"\basylum\b", r"withholding\s+of\s+removal", r"persecution"],
    "green_card": [r"adjustment\s+of\s+status", r"i-485", r"lawful\s+permanent\s+resident"],
    "f1": [
        r"\bf-?1\b", r"\bopt\b", r"stem\s+opt", r"\bcpt\b", r"\bsevis\b",
        r"i-983", r"practical\s+training", r"optional\s+practical",
        r"student\s+visa", r"designated\s+school", r"student\s+employment",
        r"alliance\s+of\s+technology\s+workers", r"technology\s+workers.*dhs",
    ],
}
TOPIC_MISMATCH = {
    "h1b": [r"\basylum\b", r"\bnaturalization\b", r"\bn-400\b", r"\bfair\s+admissions\b"],
    "h4": [r"\basylum\b", r"\bnaturalization\b", r"\bh-1b\s+cap\b"],
    "h4_ead": [r"\basylum\b", r"\bnaturalization\b", r"\bh-1b\s+cap\b"],
    "l1": [r"\basylum\b", r"\bnaturalization\b", r"\bfair\s+admissions\b"],
    "o1": [r"\basylum\b", r"\bnaturalization\b"],
    "eb1": [r"\basylum\b", r"\bfair\s+admissions\b"],
    "eb2": [r"\basylum\b", r"\bfair\s+admissions\b"],
    "f1": [
        r"\basylum\b", r"\bnaturalization\b", r"\bn-400\b",
        r"\bfair\s+admissions\b", r"\bstudents?\s+for\s+fair\b",
        r"\bh-1b\b(?!.*\b(cap[- ]?gap|student)\b)",
        r"\bspecialty\s+occupation\b(?!.*\bstudent\b)",
    ],
    "asylum": [r"\bh-1b\s+cap\b", r"\bpremium\s+processing\b"],
    "green_card": [r"\bh-1b\s+cap\b", r"\bfair\s+admissions\b"],
}
QUESTION_MISMATCH = [
    (r"\b(opt|stem\s+opt|cpt|practical\s+training|sevis|i-983)\b", [
        r"\bh-1b\b", r"\bspecialty\s+occupation\b", r"\blca\b",
        r"\bfair\s+admissions\b", r"\bstudents?\s+for\s+fair\b",
        r"\bnaturalization\b", r"\basylum\b",
    ]),
]
# topic -> question pattern after which the text must match that topic's patterns
REQUIRED_PATHWAY = {"f1": r"\b(opt|stem\s+opt|cpt|practical\s+training)\b"}
MIN_RELEVANCE = "0.28"

# --- fixed values: court decision search -------------------------------------
COURT_NAMES = {
    "ca1": "1st Circuit", "ca2": "2nd Circuit", "ca3": "3rd Circuit", "ca4": "4th Circuit",
    "ca5": "5th Circuit", "ca6": "6th Circuit", "ca7": "7th Circuit", "ca8": "8th Circuit",
    "ca9": "9th Circuit", "ca10": "10th Circuit", "ca11": "11th Circuit", "cadc": "D.C. Circuit",
    "scotus": "Supreme Court", "bia": "Board of Immigration Appeals",
    "dcd": "District Court, D.C.", "nyed": "E.D. New York", "cand": "N.D. California",
    "txsd": "S.D. Texas",
}
PRIMARY_COURTS = ["bia"]
BROADER_COURTS = ["ca9", "bia", "ca2", "ca4", "ca5", "ca11"]
ALL_COURTS = ["ca1", "ca2", "ca3", "ca4", "ca5", "ca6", "ca7", "ca8", "ca9", "ca10", "ca11", "cadc", "bia"]
SECOND_PASS_COURTS = ["ca9", "ca2", "ca4", "cadc", "bia"]
SECOND_PASS_TERMS = '"STEM OPT" "optional practical training" F-1'
PATHWAY_SEARCH_TERMS = '"STEM OPT" "optional practical training" F-1 student I-983'
DEFAULT_SEARCH_TERMS = ["immigration", "visa"]
COURT_ANCHORS = {
    "h1b": ["H-1B", "specialty occupation"],
    "h4": ["H-4", "dependent spouse"],
    "h4_ead": ["H-4", "EAD", "employment authorization", "I-765"],
    "l1": ["L-1", "intracompany transferee"],
    "o1": ["O-1", "extraordinary ability"],
    "eb1": ["EB-1", "priority worker"],
    "eb2": ["EB-2", "advanced degree", "PERM"],
    "asylum": ["asylum", "withholding of removal", "persecution"],
    "green_card": ["adjustment of status", "I-485", "lawful permanent resident"],
    "f1": ["F-1", "student", "OPT", "STEM OPT", "practical training"],
}
SEARCH_PHRASES = [
    (r"\bforms?\b|i-765|i-539|i-129|i-140|i-485", ["forms", "filing"]),
    (r"\bac21\b|portability", ["AC21", "portability", "H-1B transfer"]),
    (r"\bcap\b|lottery|registration", ["H-1B cap", "lottery", "registration"]),
    (r"\bpremium\s+processing", ["premium processing", "expedited"]),
    (r"\beligib|qualif|require", ["eligibility", "requirements"]),
    (r"\bdeni", ["denial", "denied", "appeal"]),
    (r"\bnaturalization|citizenship|n-400", ["naturalization", "citizenship"]),
    (r"\bdeport|removal|cancellation", ["deportation", "removal", "cancellation"]),
    (r"\bcompare|versus|vs\.?\b", ["comparison", "visa category"]),
    (r"\b180[- ]day|extension", ["180-day extension", "status extension"]),
    (r"\bconsular|visa\s+stamp|abroad", ["consular processing", "visa stamp"]),
    (r"\b(opt\b|stem\s+opt|cpt\b|practical\s+training|sevis|i-983)",
     ["STEM OPT", "OPT extension", "F-1 student", "Form I-983"]),
    (r"\bhow\s+long|duration|months?\b", ["24 month", "STEM OPT duration", "OPT period"]),
]
SEARCH_STOP_WORDS = [
    "what", "are", "the", "for", "how", "to", "is", "a", "an", "i", "can", "do",
    "requirements", "explain", "tell", "me", "about", "please", "help", "need",
    "that", "this", "with", "from", "when", "where", "which", "who", "why",
    "should", "would", "could", "does", "did", "have", "has", "been", "being",
    "their", "there", "these", "those", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "again", "further", "then",
    "once", "here", "all", "each", "few", "more", "most", "other", "some", "such",
    "only", "own", "same", "than", "too", "very", "just", "also", "any", "both",
]
COURT_MISMATCH = {
    "h1b": [r"\basylum\b", r"\bnaturalization\b", r"\bn-400\b", r"\bf-1\b.*\bstudent\b"],
    "h4": [r"\basylum\b", r"\bnaturalization\b", r"\bh-1b\s+cap\b"],
    "h4_ead": [r"\basylum\b", r"\bnaturalization\b", r"\bh-1b\s+cap\b"],
    "l1": [r"\basylum\b", r"\bnaturalization\b", r"\bf-1\b"],
    "o1": [r"\basylum\b", r"\bnaturalization\b"],
    "eb1": [r"\basylum\b", r"\bf-1\b.*\bstudent\b"],
    "eb2": [r"\basylum\b", r"\bf-1\b.*\bstudent\b"],
    "f1": [
        r"\basylum\b", r"\bh-1b\s+cap\b", r"\bnaturalization\b",
        r"\bfair\s+admissions\b", r"\bstudents?\s+for\s+fair\b",
        r"\bh-1b\b(?!.*\b(cap[- ]?gap|student)\b)",
    ],
    "asylum": [r"\bh-1b\s+cap\b", r"\bpremium\s+processing\b", r"\bl-1\b"],
    "green_card": [r"\bf-1\b.*\bstudent\b", r"\bh-1b\s+cap\b"],
}
COURT_TOPIC_WORDS = {
    "h1b": ["h-1b", "h1b", "specialty occupation"],
    "h4": ["h-4", "h4", "dependent spouse", "h4 dependent"],
    "h4_ead": ["h-4 ead", "h4 ead", "employment authorization", "i-765", "(c)(26)"],
    "l1": ["l-1", "l1a", "l1b", "intracompany"],
    "o1": ["o-1", "extraordinary ability"],
    "eb1": ["eb-1", "eb1", "priority worker"],
    "eb2": ["eb-2", "eb2", "advanced degree", "perm"],
    "asylum": ["asylum", "withholding of removal", "convention against torture"],
    "green_card": ["adjustment of status", "lawful permanent resident", "i-485"],
    "f1": ["f-1", "student visa", "opt", "stem opt"],
}
EAD_QUESTION = r"\bead\b|employment\s+auth|i-765|\(c\)\(26\)"
MIN_COURT_SCORE, MIN_PATHWAY_COURT_SCORE = "0.22", "0.30"
COURT_BASE_URL = "https://www.courtlistener.com"
# outcome -> words (ordered, first match wins)
COURT_OUTCOMES = [
    ("granted", ["granted", "approved", "reversed in favor"]),
    ("denied", ["denied", "dismissed", "affirmed denial"]),
    ("remanded", ["remanded", "vacated", "sent back"]),
    ("affirmed", ["affirmed", "upheld"]),
]
DECISION_OUTCOMES = [
    ("granted", ["granted", "approved", "sustained"]),
    ("denied", ["denied", "dismissed"]),
    ("remanded", ["remanded", "vacated"]),
    ("affirmed", ["affirmed", "upheld"]),
    ("reversed", ["reversed"]),
]

# --- fixed values: conversation ----------------------------------------------
SESSION_TURNS = 10
SESSION_SNIPPET_CHARS = 1200
FOLLOW_UP_PATTERN = (
    r"\b(that|those|this|it|same|above|earlier|previous|you\s+said|just\s+mentioned|"
    r"explain|clarify|elaborate|more\s+detail|tell\s+me\s+more|what\s+about|how\s+about|"
    r"can\s+you|could\s+you|why\s+is|why\s+does|what\s+if|"
    r"renewal|extension|automatic\s+extension)\b"
)
QUESTION_WORDS_PATTERN = (
    r"\b(what|which|how|forms?|needed|requirements?|documents?|steps?|fees?|timeline|mean|difference)\b"
)
COMPARE_PATTERN = r"\b(compare|versus|vs\.?)\b"
FORMS_FOLLOW_UP_PATTERN = (
    r"\b(what\s+forms?|which\s+forms?|forms?\s+(are\s+)?needed|needed\s+for\s+that|"
    r"what\s+to\s+file|which\s+documents?\s+to\s+file)\b"
)
SUBTOPIC_PATTERN = (
    r"\b(ac21|i[-\s]?140|portability|premium\s+processing|lca|perm|prevailing\s+wage)\b"
)
SUBTOPIC_CONTEXT = [
    (r"\bac21\b", "H-1B AC21 section 106 H-4 EAD eligibility evidence"),
    (r"\bi[-\s]?140\b", "H-4 EAD approved Form I-140 immigrant petition evidence"),
    (r"\bportability\b", "H-1B AC21 portability evidence"),
]
FOLLOW_UP_MAX_WORDS = 12
RECENT_YEAR = 2020
RECENT_PATTERN = r"\brecent\b|\blatest\b|\bnew\b"
AFTER_PATTERN = r"\bafter\b|\bsince\b"
BEFORE_PATTERN = r"\bbefore\b|\buntil\b"

# --- fixed values: crawl sources ---------------------------------------------
# (volume, part, number of chapters)
EXTENDED_MANIFEST = [
    (2, "c", 3), (2, "d", 4), (2, "e", 3), (2, "g", 4), (2, "h", 12), (2, "i", 3),
    (2, "j", 2), (2, "k", 2), (2, "l", 2), (2, "m", 2),
    (4, "a", 4), (4, "b", 6), (4, "c", 3), (4, "d", 3), (4, "e", 2), (4, "f", 5),
    (4, "g", 3), (4, "h", 2), (4, "i", 2), (4, "j", 2), (4, "k", 2), (4, "l", 2), (4, "m", 2),
    (5, "a", 3), (5, "b", 4), (5, "c", 3), (5, "d", 2), (5, "e", 2), (5, "f", 2), (5, "g", 2), (5, "h", 2),
    (6, "a", 4), (6, "c", 3), (6, "h", 4),
    (11, "a", 3), (11, "b", 3), (11, "c", 3), (11, "d", 2), (11, "e", 2), (11, "f", 2), (11, "g", 2), (11, "h", 2),
    (3, "a", 3), (3, "d", 3), (3, "e", 2), (3, "f", 2),
]
DIRECT_MANIFEST = [
    (1, "a", 3), (1, "b", 3), (2, "a", 2), (2, "b", 3), (2, "f", 5), (3, "b", 3), (3, "c", 2),
    (6, "b", 4), (6, "d", 3), (6, "e", 2), (6, "f", 4), (6, "g", 3), (7, "a", 3), (7, "b", 3),
    (8, "a", 2), (8, "b", 3), (8, "g", 3), (9, "a", 2), (9, "b", 2), (10, "a", 2), (10, "b", 2),
    (12, "a", 2), (12, "b", 4), (12, "d", 3),
]
CHAPTER_URL_PREFIX = "https://www.uscis.gov/policy-manual/volume-"
CHAPTER_URL_PATTERN = r"/policy-manual/volume-(\d+)-part-([a-z])-chapter-(\d+)"
CHAPTER_TARGET = 200
VOLUME_PART_TOPICS = [
    (2, "h", "h1b"), (2, "f", "l1"), (2, "g", "o1"),
    (4, "a", "asylum"), (4, "b", "asylum"), (4, "c", "asylum"), (4, "d", "asylum"),
    (4, "e", "asylum"), (4, "f", "asylum"),
    (6, "a", "green_card"), (6, "b", "green_card"), (6, "d", "eb1"), (6, "e", "eb2"),
    (6, "f", "l1"), (6, "g", "o1"), (6, "h", "f1"),
    (7, "a", "green_card"), (7, "b", "green_card"),
    (10, "a", "h4_ead"), (10, "b", "h4_ead"),
    (12, "a", "f1"), (12, "b", "f1"), (12, "d", "f1"),
]
VOLUME_SUBJECTS = {
    "1": "General Policies", "2": "Nonimmigrant Visas", "3": "Humanitarian Protection",
    "6": "Immigrant Visas", "7": "Adjustment of Status", "8": "Admissibility",
    "9": "Waivers", "10": "Employment Authorization", "11": "Travel Documents",
    "12": "Citizenship & Naturalization",
}
ARTICLE_LINK_PARTS = ["/newsroom/alerts/", "/newsroom/news-releases/", "/newsroom/policy-manual-updates/"]
CHAPTER_LINK_PARTS = ["/policy-manual/volume-", "-chapter-"]
NEWS_ARTICLE_LIMIT = 100
URL_ALERT_TYPES = [
    ("alerts", "Alert"), ("news-releases", "News Release"), ("policy-manual-updates", "Policy Update"),
]
TEXT_ALERT_TYPES = [
    (["fee", "filing fee", "premium processing"], "Fee Update"),
    (["form", "i-765", "i-485", "i-129"], "Form Update"),
]
DEFAULT_ALERT_TYPE = "News"
ALERT_SOURCES = ["uscis_news", "uscis_policy"]
NEWS_NOISE = [
    r"Skip to main content.*?\n", r"Breadcrumb.*?\n", r"Share this page.*?\n",
    r"Was this page helpful.*", r"An official website.*?\n", r"USCIS\.gov.*?\n",
]
POLICY_NOISE = [
    r"Skip to main content.*?\n", r"Breadcrumb.*?\n", r"Share this page.*?\n",
    r"Last Reviewed.*?\n", r"Was this page helpful.*", r"USCIS\.gov.*?\n",
    r"An official website.*?\n",
]
REMOVED_TAGS = ["script", "style", "noscript", "iframe", "form", "meta", "link"]
REMOVED_CLASSES = [
    "breadcrumb", "usa-nav", "usa-footer", "usa-banner", "usa-header", "site-header",
    "site-footer", "back-to-top", "pagination", "feedback",
]
MAIN_CLASSES = "main-content|policy-content|chapter"
SCRAPE_FAILURE_MESSAGE = "Page scrape failed after retries"
MANUAL_LABEL = "USCIS Policy Manual"
MANUAL_FILE_PREFIX = "uscis_policy_www_uscis_gov_policy_manual_"
CASE_FILE_NOISE = ["bia_", "aao_", "uscis_news_", "www_courtlistener_com_opinion_", ".txt"]
CASE_PLACEHOLDER = "Immigration Case Precedent"

# --- fixed values: retrieval and dashboards ----------------------------------
RRF_K = 60
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
TOP_K, RERANK_TOP_N, MAX_CASES, MAX_SCOPED_DOCS = 8, 6, 5, 50
MIN_SECTION_SIMILARITY = 0.75
MAX_RESOLVED_REFS = 2
CONTEXT_CHARS = 36000
CONTEXT_TRIM_NOTE = "\n\n[Context trimmed due to length limit]"
CONTEXT_HEADINGS = {
    "law": "## RELEVANT LAWS AND POLICIES",
    "case": "## RELEVANT CASE PRECEDENTS",
    "court": "## RELEVANT COURT DECISIONS",
}
CORPUS_TARGETS = {"law": (260, 2120), "case": (244, 5860)}
ROLE_RANKS = {"super_admin": 4, "admin": 3, "attorney": 2, "junior_associate": 1}
RATE_LIMITS = {"/api/v1/chat/query": (20, 60), "/api/v1/auth/login": (10, 60), "/api/v1/auth/register": (5, 60)}
CACHE_VERSION, CACHE_PREFIX, CACHE_TTL_SECONDS = "v2", "query_cache:", 3600
LOW_SATISFACTION = (5, 60)
