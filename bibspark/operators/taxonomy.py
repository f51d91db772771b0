"""Rule taxonomies as data. Any list of Rule and Direction can be compiled (classify.py)."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    code: str
    label: str
    group: str
    patterns: tuple[str, ...]


class Direction(NamedTuple):
    code: str
    label: str
    target: int
    patterns: tuple[str, ...]
    title_patterns: tuple[str, ...]
    allowed: tuple[str, ...] = ()


# ---- fixed values: codes, labels and patterns of the education taxonomy, its signals and weights
EDUCATION_RULES = (
    Rule("T01", "Intelligent tutoring for writing and reading", "reference_topic", (r"writing\s+(?:pal|tutor)", r"reading\s+(?:tutor|comprehension)", r"intelligent tutor(?:ing)?[^.]{0,50}(?:writing|reading|literacy)", r"(?:writing|reading|literacy)[^.]{0,50}intelligent tutor")),
    Rule("T02", "ITS authoring and scaffolding", "reference_topic", (r"authoring (?:tool|system|environment)", r"scaffold(?:ing|ed|s)?", r"example[- ]tracing tutor", r"help[- ]seeking", r"(?:hint|feedback)[^.]{0,40}(?:tutor|tutoring system)")),
    Rule("T03", "Computer science and AI education", "reference_topic", (r"computer science education", r"programming education", r"teach(?:ing)? (?:programming|machine learning|artificial intelligence|ai)", r"learn(?:ing)? (?:programming|machine learning|artificial intelligence|ai)", r"ai literacy", r"machine learning education")),
    Rule("T04", "Game-based learning", "reference_topic", (r"game[- ]based learning", r"educational game", r"serious game", r"gamif(?:ication|ied|y)")),
    Rule("T05", "ML-supported collaborative learning and discourse", "reference_topic", (r"computer[- ]supported collaborative learning", r"\bcscl\b", r"collaborative learning", r"collaborative discourse", r"discourse analysis")),
    Rule("T06", "NLP and dialogue systems for education", "reference_topic", (r"natural language processing", r"dialogue system", r"dialog system", r"conversational (?:agent|tutor|system)", r"educational chatbot", r"chatbot[^.]{0,40}(?:education|learning|teaching|student)")),
    Rule("T07", "Educational data mining and learning analytics", "reference_topic", (r"educational data mining", r"learning analytics", r"student (?:performance|success|dropout) prediction", r"predict(?:ing|ion of)? (?:student|academic|learning) performance", r"academic performance prediction", r"early warning system")),
    Rule("T08", "Problem-solving and example-based learning", "reference_topic", (r"problem[- ]solving", r"example[- ]based learning", r"worked example", r"solution trace")),
    Rule("T09", "Ontology and knowledge management", "reference_topic", (r"ontolog(?:y|ies|ical)", r"knowledge management", r"semantic web", r"knowledge base[^.]{0,50}(?:education|learning|tutor|student)")),
    Rule("T10", "Adaptive testing and diagnosis systems", "reference_topic", (r"computerized adaptive test", r"computerised adaptive test", r"adaptive assessment", r"diagnos(?:is|tic)[^.]{0,40}(?:learner|student|knowledge|learning)", r"knowledge tracing", r"student model(?:ing|ling)?")),
    Rule("T11", "Intelligent systems for medical and professional training", "reference_topic", (r"virtual surgery", r"surgery training", r"medical education", r"clinical education", r"nursing education", r"radiology education", r"professional training")),
    Rule("T12", "Neural networks for prediction and teaching evaluation", "reference_topic", (r"artificial neural network", r"neural network", r"deep neural", r"convolutional neural", r"recurrent neural", r"\bcnn\b", r"\blstm\b")),
    Rule("T13", "Graphical representation and knowledge connection", "reference_topic", (r"graphical representation", r"knowledge connection", r"concept map", r"knowledge graph", r"learning visualization", r"learning visualisation")),
    Rule("T14", "Educational robots and robot-assisted learning", "reference_topic", (r"educational robot", r"robot[- ]assisted learning", r"social robot", r"robot tutor", r"robotics education")),
    Rule("T15", "Affective computing and learner emotion", "reference_topic", (r"affective computing", r"affective learning", r"emotion (?:detection|recognition|regulation)", r"learner emotion", r"student emotion", r"affect detection", r"affective feedback")),
    Rule("T16", "Intelligent tutoring for K-12 and special education", "reference_topic", (r"\bk[-– ]?12\b", r"primary school", r"elementary school", r"secondary school", r"special education", r"autis(?:m|tic)", r"learning disabilit", r"special needs")),
    Rule("T17", "Recommender systems and personalized learning", "reference_future_extension", (r"educational recommender", r"recommender system", r"recommendation system", r"personalized learning", r"personalised learning", r"personalized learning path", r"personalised learning path")),
    Rule("E01", "Generative AI and large language models in education", "post_2019_extension", (r"generative (?:artificial intelligence|ai)", r"large language model", r"\bllms?\b", r"\bchatgpt\b", r"\bgpt[- ]?[234o]?\b", r"foundation model")),
    Rule("E02", "Ethics, governance, privacy, and fairness in AIEd", "post_2019_extension", (r"ethic(?:al|s)", r"privacy", r"data protection", r"algorithmic bias", r"fairness", r"responsible ai", r"governance", r"(?:ai|artificial intelligence) policy", r"policy[^.]{0,50}(?:ai|artificial intelligence)")),
)
FALLBACK = Rule("O01", "Other or field-level AIEd research", "other_aied", ())
REFERENCE_TITLE = "Two Decades of Artificial Intelligence in Education: Contributors, Collaborations, Research Topics, Challenges, and Future Directions"
DIRECTION_QUERIES = {
    "F01": ('"intelligent tutoring system" "special education"', '"intelligent tutoring" autism education'),
    "F02": ('"natural language processing" "language education"', '"intelligent tutoring" writing reading language'),
    "F03": ('"educational robot" learning', '"robot-assisted learning" education'),
    "F04": ('"educational data mining" "student performance prediction"', '"learning analytics" "academic performance prediction"'),
    "F05": ('"discourse analysis" "computer-supported collaborative learning"', "machine learning CSCL collaborative discourse"),
    "F06": ('"neural network" "teaching evaluation"', '"neural network" "teaching quality evaluation" education'),
    "F07": ('"affective computing" learner emotion education', '"emotion detection" "intelligent tutoring system"'),
    "F08": ('"educational recommender system" personalized learning', '"recommender system" adaptive learning education'),
    "M01": (f'"{REFERENCE_TITLE}"', '"artificial intelligence in education" bibliometric review', '"artificial intelligence in education" topic trends collaboration institutions'),
}
EXCLUDED = Rule("X00", "Out of scope or insufficient AIEd evidence", "excluded", ())

_special = r"(?:special education|autis|disabilit|special needs)"
_nlp = (r"(?:natural language processing|dialogue|chatbot|writing tutor|reading tutor)", r"(?:language (?:learning|education|teaching|learner)|writing|reading|literacy)")
_robot = (r"robot", r"(?:education|educational|teaching|student|school|classroom|language learning|learning outcome)")
_edm = (r"(?:educational data mining|learning analytics)", r"(?:predict|performance|dropout|early warning|retention)")
_cscl = (r"(?:discourse|cscl|computer.supported collaborative|collaborative learning)", r"(?:analysis|machine learning|artificial intelligence|automated)")
_nn = (r"(?:neural networks?|\bcnn\b|\blstm\b|deep learning(?:[- ]based| (?:model|algorithm|technique|method|architecture))|using deep learning)", r"(?:teaching(?: quality)? evaluation|evaluation of [^.]{0,30} teaching|classroom teaching behavior)")
_affect = (r"\b(?:affect(?:ive)?|emotion(?:al)?)\w*\b", r"\b(?:learner|learners|student|students|education|educational|tutor|tutors|tutoring)\b|learning (?:environment|process)")
_biblio = (r"artificial intelligence[^.]{0,25}education|aied", r"(?:bibliometric|review|trend|topic|collaboration|institution|country|contributor)")
EDUCATION_DIRECTIONS = (
    Direction("F01", "ITS for special education", 5, (r"(?:intelligent tutor|tutoring system)", _special), (_special,), ("T01", "T02", "T12", "T14", "T16")),
    Direction("F02", "NLP for language education", 5, _nlp, _nlp),
    Direction("F03", "Educational robots for AI education", 5, _robot, _robot),
    Direction("F04", "EDM for performance prediction", 5, _edm, _edm),
    Direction("F05", "Discourse analysis in CSCL", 5, _cscl, _cscl),
    Direction("F06", "Neural networks for teaching evaluation", 5, _nn, _nn, ("T07", "T12", "T15")),
    Direction("F07", "Affective computing for learner emotion detection", 5, _affect, _affect),
    Direction("F08", "Recommender systems for personalized learning", 5, (r"(?:recommender|recommendation system)", r"(?:education|learning|student|course|personaliz|personalis)"), (r"(?:recommender|recommendation system)", r"(?:e-learning|education|educational|student|course|learning (?:object|resource|path|system))")),
    Direction("M01", "AIEd bibliometrics, contributors, collaborations, and topic trends", 10, _biblio, _biblio),
)
EDUCATION = r"\b(?:education|educational|learner|student|teacher|teaching|tutor|school|classroom|pedagog|academic|assessment|curriculum|instruction)\w*\b"
AI = r"\b(?:artificial intelligence|machine learning|deep learning|neural|intelligent|data mining|learning analytics|natural language processing|nlp|chatbot|robot|algorithm|predict|recommender|adaptive|knowledge tracing|affective computing)\w*\b"
REVIEW = r"\b(?:systematic review|literature review|scoping review|meta-analysis|meta analysis|bibliometric|survey|review of|research trends|state of the field|narrative overview)\b"
WEIGHTS = {"title": 5.0, "abstract": 1.0, "concepts": 1.5, "keywords": 2.0, "query": 0.5}
REVIEW_TERMS = ("review", "survey", "meta-analysis", "meta analysis", "bibliometric", "scoping", "systematic revision")
# ---- end of fixed values
