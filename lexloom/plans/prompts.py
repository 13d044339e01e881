"""Prompt records: which sections a question's prompt has, and how long it is.

No model is called. Which sections appear and in which order is fixed here; their
wording is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import lit_or_col
from ..rules import domain as D

# fixed values: section headings of the user message
HEADINGS = {
    "query": "## QUERY CONTEXT", "matter": "## MATTER MODE", "conversation": "## CONVERSATION CONTEXT",
    "follow_up": "## FOLLOW-UP CONTEXT", "checklist": "## COMPLETENESS CHECKLIST FOR THIS QUERY",
    "reference": "## REFERENCE MATERIAL", "review": "## ATTORNEY QUESTION", "question": "## QUESTION",
}

# Default wording; callers pass their own.
WORDING = {
    "system": "Write a research memo for an attorney from the given sources only. Keep every figure, date and fee. "
              "Use the agreed section headers.",
    "compare": "Set the options side by side and end with a comparison table.",
    "doc_review": "Review the client's document: issues, missing evidence, suggested changes.",
    "conversation": "Earlier questions and answers are included; resolve references to them.",
    "follow_up": "The question refers to the exchange just before; answer it directly.",
    "forms": "List the required forms first, then the supporting documents.",
    "matter": "Tailor the answer to the facts of the matter notes.",
    "thread": "The question may continue that thread.",
    "direct": "Answer the current question, not the one before.",
    "use_all": "Use every relevant fact of these sources.",
    "no_sources": "No reference material was found; say so and do not speculate.",
    "ask_review": "Critique the draft above and support each point with a source.",
    "ask_follow_up": "Answer this follow-up from the conversation and the sources.",
    "ask_forms": " Begin with form numbers and categories.",
    "ask_no_forms": " Leave out form lists given before.",
    "ask": "Write the complete memo in the required format.",
}

# (condition name, hint wording); conditions are evaluated in ``checklist``
HINTS = [
    ("forms", "Forms follow-up: list forms and supporting documents only."),
    ("ac21", "Evidence for job portability: say what proves eligibility."),
    ("i140", "Petition approval evidence: say which notice proves it."),
    ("cap", "Annual cap: give numbers, fee, dates, selection and start date."),
    ("ead", "Work permit: give triggers, category code, evidence and timing."),
    ("eligibility", "Eligibility: list every criterion."),
    ("compare", "Comparison: cover eligibility, process, timeline and risks of each option."),
    ("filing", "Filing: give form numbers, fees and evidence."),
]
# fixed values: question patterns behind the hints
HINT_PATTERNS = {
    "ac21": [r"\bac21\b"],
    "i140": [r"\bi[-\s]?140\b", r"\bevidence\b"],
    "cap": [r"\b(cap|lottery|registration)\b"],
    "cap_topic": [r"\bh[-\s]?1b\b"],
    "ead": [r"\b(ead|work\s+auth|employment\s+authorization)\b"],
    "eligibility": [r"\b(eligib|require|qualif)\b"],
    "compare": [r"\b(compare|difference|vs\.?|versus)\b"],
    "filing": [r"\b(form|file|filing|petition)\b"],
}


def checklist(query, topic, forms_follow_up, patterns=HINT_PATTERNS, hints=HINTS, cap_topic: str = "h1b", flags: str = D.I) -> Column:
    """Checklist section, null where no hint applies."""
    q, topic = lit_or_col(query), lit_or_col(topic)

    def asked(name):
        cond = F.lit(True)
        for p in patterns[name]:
            cond = cond & q.rlike(flags + p)
        return cond

    conds = {n: asked(n) for n in patterns}
    conds["forms"] = lit_or_col(forms_follow_up)
    conds["cap"] = conds["cap"] & (conds["cap_topic"] | F.coalesce(topic == cap_topic, F.lit(False)))
    lines = F.concat_ws("\n", *[F.when(conds[n], F.lit("- " + text)) for n, text in hints])
    return F.when(lines != "", F.concat(F.lit(HEADINGS["checklist"] + "\n"), lines))


def assemble(query, context_text, law_refs, case_refs, topic, mode, has_conversation, follow_up, forms_follow_up, prior_query,
             has_matter, wording=WORDING, patterns=HINT_PATTERNS, cap_topic: str = "h1b", flags: str = D.I) -> Column:
    """STRUCT(system_message, user_message, total_chars)."""
    q, topic, mode = lit_or_col(query), F.nullif(lit_or_col(topic), F.lit("")), lit_or_col(mode)
    conv, follow, forms = (lit_or_col(c) for c in (has_conversation, follow_up, forms_follow_up))
    prior, w, h = F.nullif(lit_or_col(prior_query), F.lit("")), wording, HEADINGS
    plain = ~F.coalesce(mode.isin("compare", "doc_review"), F.lit(False))
    system = F.concat_ws(
        "\n\n", F.lit(w["system"]),
        F.when(mode == "compare", F.lit(w["compare"])), F.when(mode == "doc_review", F.lit(w["doc_review"])),
        F.when(plain & conv, F.lit(w["conversation"])), F.when(plain & follow, F.lit(w["follow_up"])),
        F.when(plain & forms, F.lit(w["forms"])),
    )
    context = F.coalesce(lit_or_col(context_text), F.lit(""))
    # court decisions are shown on their own and left out of the prompt
    context = F.regexp_replace(F.substring_index(context, D.CONTEXT_HEADINGS["court"], 1), r"(?U)^\s+|\s+$", "")
    n = lambda c: F.greatest(F.size(F.coalesce(lit_or_col(c))), F.lit(0)).cast("string")
    reference = F.when(
        context != "",
        F.concat(F.lit(h["reference"] + " ("), n(law_refs), F.lit(" law sources, "), n(case_refs),
                 F.lit(f" case sources)\n{w['use_all']}\n\n"), context),
    ).otherwise(F.lit(f"{h['reference']}\n{w['no_sources']}"))
    ask = (
        F.when(mode == "doc_review", F.concat(F.lit(h["review"] + "\n"), q, F.lit("\n\n" + w["ask_review"])))
        .when(follow, F.concat(
            F.lit(h["question"] + "\n"), q, F.lit("\n\n" + w["ask_follow_up"]),
            F.when(forms, F.lit(w["ask_forms"])).otherwise(F.lit(w["ask_no_forms"])),
        ))
        .otherwise(F.concat(F.lit(h["question"] + "\n"), q, F.lit("\n\n" + w["ask"])))
    )
    user = F.concat_ws(
        "\n\n",
        F.concat(F.lit(h["query"] + "\nVisa Category: "), F.replace(F.upper(topic), F.lit("_"), F.lit("-")), F.lit("\n")),
        F.when(lit_or_col(has_matter), F.lit(f"{h['matter']}\n{w['matter']}")),
        F.when(conv & ~follow, F.concat(F.lit(h["conversation"] + "\nMost recent question: "), prior, F.lit("\n" + w["thread"]))),
        F.when(follow, F.concat(F.lit(h["follow_up"] + "\nPrior question: "), prior, F.lit("\n" + w["direct"]))),
        checklist(q, topic, forms, patterns, cap_topic=cap_topic, flags=flags), reference, ask,
    )
    return F.struct(
        system.alias("system_message"), user.alias("user_message"), (F.length(system) + F.length(user)).alias("total_chars")
    )
