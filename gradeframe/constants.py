"""Lists, patterns, thresholds and texts that define the benchmark results."""

# --- fixed values: answer labels -------------------------------------------------------
LABELS = ["A", "B", "C", "D"]
INVALID = "INVALID"
NO_PREDICTION = "None"
UNKNOWN_SUBJECT = "Unknown"
IMAGE_CHOICE = "[image]"

# --- fixed values: columns that may carry a subject, in order of preference ------------
SUBJECT_COLUMNS = ["subject_category", "subject", "category", "section", "topic"]

# --- fixed values: keys -----------------------------------------------------------------
PREDICTION_KEYS = ["experiment_tag", "eval_split_name", "model_key", "question_id"]
REQUIRED_ITEM_KEYS = ["question", "opa", "opb", "opc", "opd", "cop"]
REQUIRED_QUESTION_FIELDS = ["question", "option_a", "option_b", "option_c", "option_d", "correct_answer"]
UPDATABLE_QUESTION_FIELDS = [
    "question", "option_a", "option_b", "option_c", "option_d",
    "correct_answer", "subject", "topic", "explanation", "image_url",
]
QUESTION_EXPORT_COLUMNS = [
    "id", "question", "option_a", "option_b", "option_c", "option_d",
    "correct_answer", "subject", "topic", "explanation",
]

# --- fixed values: thresholds -----------------------------------------------------------
COMPLETE_ROWS = 225
MAX_PER_SUBJECT = 800
GATE_THRESHOLD = 0.7
OVERRIDE_THRESHOLD = 0.35
CONFIDENCE_Z = 1.96
ERROR_SAMPLE_ROWS = 50
EXAM_QUESTIONS = 5
RETRIEVED_CONTEXTS = 20
PIPELINE_TIMEOUT = "30 minutes"

# --- fixed values: white space as Python's str.strip() knows it -------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: patterns for the answer letter (Java syntax) -------------------------
# A letter stands alone when no Unicode letter, digit or underscore touches it.
NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"
STANDALONE_LETTER = NO_WORD_BEFORE + r"([A-D])" + NO_WORD_AFTER
FINAL_ANSWER = r"(?U)[Ff]inal\s+[Aa]nswer\s*[:\-]?\s*\**\s*([A-Da-d])" + NO_WORD_AFTER
ANSWER_TAG = r"(?U)[Aa]nswer\s*[:\-]?\s*\**\s*([A-Da-d])" + NO_WORD_AFTER
THE_ANSWER_IS = r"(?iU)the\s+answer\s+is\s+\**\s*([A-D])" + NO_WORD_AFTER
ANSWER_UPPER = r"(?U)ANSWER\s*[:\-]?\s*([A-D])"
ANSWER_COLON = r"(?iU)Answer:\s*\**\s*([ABCD])" + NO_WORD_AFTER
THINK_BLOCK = r"(?s)<think>.*?</think>"
THINK_END = "</think>"
EXPLANATION = r"(?isU)Explanation:\s*(.+?)(?:\nAnswer:|\z)"
EXPLANATION_LIMIT = 500
CORRECT_ANSWER_IS = r"(?iU)correct answer is\s+([A-D])"
SOLUTION_IS = r"(?iU)The solution is\s+([A-D])"
PAGE_ANSWER_IS = r"(?iU)correct answer is\s*([A-D])"

# --- fixed values: references to figures, image markers ---------------------------------
FIGURE_REFERENCES = [
    NO_WORD_BEFORE + r"(?U)((?:Figure|Fig\.)\s*\d+)",
    NO_WORD_BEFORE + r"(?U)(Table\s+\d+)",
    NO_WORD_BEFORE + r"(?U)((?:Graph|Diagram|Chart)\s+\d+)",
]
IMAGE_OPENING = "[Image: "
IMAGE_MARKER = r"\[Image: [^\]]+\]"
IMAGE_PATH = r"\[Image: ([^\]]+)\]"
SPACED_IMAGE_MARKER = r"(?U)\s*\[Image: [^\]]+\]"

# --- fixed values: exam page boilerplate ------------------------------------------------
BOILERPLATE_FRAGMENTS = [
    "Skip to main content",
    "Done Reviewing",
    "Provide Feedback",
    "\u00a9 2026 AAMC",
    "\u00a9 2025 AAMC",
    "\u00a9 2024 AAMC",
    "Contact Us",
    "Web Accessibility",
    "Terms and Conditions",
    "Privacy Statement",
]
NEXT_QUESTION = r"(?iU)^next question\s*\d*$"
HEADER_MARKERS = ["Skip to main content", "Unscored Sample Test", "Done Reviewing"]
FOOTER_MARKERS = [
    "Khan Academy Lessons",
    "Content & Skills",
    "Content &\xa0Skills",
    "Provide Feedback on AAMC",
    "\u00a9 2026 AAMC",
    "Contact Us Web Accessibility",
]
NAVIGATION_WORDS = ["Plan", "Tasks", "Practice", "Resources", "Search"]
SUBJECT_CODES = ["BIO", "BCH", "GCH", "PHY", "PSY", "SOC", "ORG", "OCH"]
SUBJECT_CODE_NAMES = {
    "BIO": "Biology",
    "BCH": "Biochemistry",
    "GCH": "General Chemistry",
    "PHY": "Physics",
    "PSY": "Psychology",
    "SOC": "Sociology",
    "ORG": "Organic Chemistry",
    "OCH": "Organic Chemistry",
    "CARS": "Critical Analysis and Reasoning Skills",
}
DEFAULT_CODE_NAME = "MCAT"

# --- fixed values: patterns and markers of exam pages -----------------------------------
BARE_CHOICE = r"(?U)^([A-D])\.\s*$"
INLINE_CHOICE = r"(?dU)^([A-D])\.\s*(\S.+)"
ANY_CHOICE = r"^[A-D]\."
PAGE_MARKERS = {
    "question": "Question",
    "separator": "_",
    "your_answer": "Your Answer:",
    "correct_answer": "Correct Answer:",
    "confidence": "Confidence Level:",
    "skills": "Content & Skills",
    "option_rationale": "Option Rationale:",
    "item_rationale": "Item Rationale:",
}
SOLUTION_STARTS = ["Solution:", "The solution is"]
SOLUTION_PREFIXES = [r"(?U)^Solution:\s*The correct answer is\s+[A-D]\.\s*", r"(?U)^The solution is\s+[A-D]:\s*"]
VERDICT_LINES = ["Correct", "Incorrect"]
VERDICT = r"(?U)^(Correct|Incorrect)\.\s*"
TIME_SPENT = "Time Spent:"
QUESTION_NUMBER = r"^\d+/\d+$"
PASSAGE_HEAD = r"(?U)^Passage\s+\d+"
ADAPTED_FROM = "Adapted from"
MATERIAL_USED = "Material used in this"
ELIMINATED_LINE = "Answer choice eliminated"
NOT_SELECTED = "Not Selected"
SKILL_PREFIX = r"(?U)^Skill:\s*"
SKILLS_END = [r"(?i)^next question", r"(?iU)^[A-D]\s+selected$"]
OPTION_HEAD = r"(?U)^Option\s+[A-D]:"
OPTION_TEXT = r"(?dU)^Option\s+[A-D]:\s*(.*)"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
STOCK_SENTENCES = [
    r"(?iU)^Thus,?\s+[A-D]\s+is\s+(the\s+)?(best|correct)\s+answer",
    r"(?iU)^(Choice|Option)\s+[A-D]\s+is\s+(the\s+)?(best|correct)",
]
DEFAULT_RIGHT = "Correct. See explanation below."
DEFAULT_WRONG = "Incorrect based on the information provided."
CONCEPT_SENTENCES = [r"(?dU)^(This is an?\s+.+?question\s+that\s+.+?\.)", r"(?dU)^(This question\s+.+?\.)"]
CONCEPT_PREFIX = r"(?U)^This is an?\s+\w+\s+question\s+that\s+falls under the content category\s*"
QUOTED_CONCEPT = r'(?dU)^"(.+?)"\.?\s*'
RATIONALE_START = r"(?dU)^This is a\s+.+\s+question\s+because"
WHY_STOCK = [
    r'(?U)^This is an?\s+\w+\s+question\s+that\s+falls under\s+the\s+content\s+category\s*"[^"]*"\.\s*',
    r"(?U)^The answer to this question is [A-D] because\s+",
    r"(?dU)\s*It is a [\w\s]+question because it requires.*$",
]
WHY_CONCLUSION = r"(?U)^Thus,?\s+[A-D]\s+is\s+(the\s+)?(best|correct)\s+answer\.?\s*$"
DEFAULT_WHY = "See elimination reasoning above."

# --- fixed values: bands and labels of reports ------------------------------------------
SCORE_BANDS = [(70, "Excellent!"), (50, "Good effort")]
LOWEST_BAND = "Keep studying"
PRECISION_RULES = [("LoRA", "BF16"), ("Q4_K_M", "Q4_K_M")]
DEFAULT_PRECISION = "q4_0"
HARDWARE_RULES = [("DGX8", "DGX8 GB10")]
DEFAULT_HARDWARE = "MacBook Pro (MPS/CPU)"

# --- fixed values: prompt texts ---------------------------------------------------------
TUTOR_SYSTEM = (
    "You are a helpful tutor for pre-med students preparing for the MCAT. "
    "You answer multiple-choice questions with step-by-step reasoning."
)
TUNED_SYSTEM = (
    "You are a helpful tutor for pre-med students preparing for medical entrance exams. "
    "Answer the following multiple choice question by thinking step by step, then give the answer."
)
PAGE_SYSTEM = (
    "You are an MCAT tutor. Solve the question by identifying the key concept, "
    "eliminating incorrect answer choices, and then choosing the best answer."
)
RESPONSE_FORMAT = (
    "Think step by step. Then respond in the format:\n"
    "Explanation: ...\nAnswer: <one of A, B, C, D>"
)
IMAGE_LINE = "Image Description: [not used in Stage 1]\n"
EVAL_PROMPT = (
    "Question: {question}\n{image_line}Options:\nA. {a}\nB. {b}\nC. {c}\nD. {d}\n\n" + RESPONSE_FORMAT
)
TRAINING_ANSWER = "Explanation: {explanation}\nAnswer: {letter}"
DEFAULT_EXPLANATION = "The correct answer is {letter} based on medical knowledge."
PASSAGE_BODY = (
    "Passage:\n{passage}\n\nQuestion:\n{question}\n\nChoices:\nA. {a}\nB. {b}\nC. {c}\nD. {d}\n"
)
PASSAGE_PROMPT = PASSAGE_BODY + "\nReturn only one capital letter: A, B, C, or D.\n"
COT_PROMPT = "/no_think\n{instructions}\n\n" + PASSAGE_BODY
TUNED_PASSAGE = "Passage: {passage}\n\n"
TUNED_PROMPT = "{passage_part}Question: {question}\nOptions: A. {a} B. {b} C. {c} D. {d}\n" + RESPONSE_FORMAT
CROSS_TEXT = "Question: {question} Options: A. {a} B. {b} C. {c} D. {d}"
CROSS_CONTEXT = "Context: {context} "
QUESTION_BLOCK = "Question: {question}\nA. {a}\nB. {b}\nC. {c}\nD. {d}\n\n"
EXPLAIN_RIGHT = QUESTION_BLOCK + (
    "The correct answer is {right}. Please explain in 2-3 sentences why this is the right answer, "
    "focusing on the key medical concept."
)
EXPLAIN_WRONG = QUESTION_BLOCK + (
    "The correct answer is {right} (the student answered {given}). Please explain in 2-3 sentences why "
    "{right} is correct and why {given} is incorrect, focusing on the key medical concept."
)
ANSWER_PROMPT = QUESTION_BLOCK + "Respond with only a single letter: A, B, C, or D.\nAnswer:"
INDENTED_OPTIONS = "Question: {question}\n\nOptions:\n  A. {a}\n  B. {b}\n  C. {c}\n  D. {d}\n"
INDEPENDENT_PROMPT = (
    "You are a medical expert. Answer this multiple-choice question.\n"
    "Think step by step, then provide your answer.\n\n" + INDENTED_OPTIONS + "{context_part}\n"
    "Think step by step. Then respond in the format:\n"
    "Explanation: <your reasoning>\nAnswer: <one of A, B, C, D>"
)
INDEPENDENT_CONTEXT = "\nContext:\n{context}\n"
EDUCATOR_PROMPT = (
    "You are a medical educator. Explain briefly why the chosen answer is correct.\n"
    "Be factual and concise (under 200 words). Do not change the labeled answer.\n\n" + INDENTED_OPTIONS +
    "\nSelected answer: {letter}\n{context_part}\n"
    "Provide a short explanation referencing the key medical concept."
)
EDUCATOR_CONTEXT = "\nSupporting context (may be incomplete):\n{context}\n"
PARSED_PASSAGE = "Passage:\n{passage}\n\n"
PARSED_USER = "{passage_part}Question:\n{question}\n\nChoices:\n{choices}"
PARSED_ASSISTANT = "Concept:\n{concept}\n\nElimination:\n{elimination}\n\nAnswer:\n{answer}\n\nWhy:\n{why}"
SUBJECT_SYSTEM_PROMPTS = {
    "CARS": (
        "You are an expert MCAT tutor specializing in Critical Analysis and Reasoning Skills (CARS). "
        "Answer questions by reasoning carefully through the passage."
    ),
    "BB": (
        "You are an expert MCAT tutor specializing in Biological and Biochemical Foundations of Living Systems. "
        "Answer questions by applying your knowledge of biology and biochemistry."
    ),
    "CP": (
        "You are an expert MCAT tutor specializing in Chemical and Physical Foundations of Biological Systems. "
        "Answer questions by applying your knowledge of chemistry and physics."
    ),
    "PS": (
        "You are an expert MCAT tutor specializing in Psychological, Social, and Biological Foundations of Behavior. "
        "Answer questions by applying your knowledge of psychology and sociology."
    ),
}
DEFAULT_SYSTEM_PROMPT = (
    "You are an expert MCAT tutor. Answer the question step by step, "
    "then give the final answer as a single option letter (A, B, C, or D)."
)
SUBJECT_INSTRUCTIONS = {
    "CARS": (
        "Answer the MCAT CARS question step by step.\n\n"
        "Rules:\n"
        "1. Identify the author's main point first.\n"
        "2. Determine what the question is really asking.\n"
        "3. Find the key lines or ideas from the passage that matter most.\n"
        "4. Evaluate each answer choice against the passage, not outside knowledge.\n"
        "5. Eliminate wrong choices briefly.\n"
        "6. Give the final answer as a single option letter.\n\n"
        "Be concise but explicit."
    ),
    "BB": (
        "Answer the MCAT Bio/Biochem question step by step.\n\n"
        "Rules:\n"
        "1. Identify the core biological or biochemical concept first.\n"
        "2. Determine whether the question depends on passage data, background knowledge, or both.\n"
        "3. Extract the key experimental details, variables, or relationships from the passage/question.\n"
        "4. Link the evidence to the biological mechanism.\n"
        "5. Eliminate wrong choices briefly.\n"
        "6. Give the final answer as a single option letter.\n\n"
        "Be concise but explicit."
    ),
    "CP": (
        "You are solving an MCAT Chem/Phys question.\n\n"
        "Return your answer in this format:\n"
        "Concept:\n"
        "Equation/Principle:\n"
        "Given information:\n"
        "Solve:\n"
        "Unit check:\n"
        "Eliminate choices:\n"
        "Final answer:\n\n"
        "Keep each line short and precise.\n"
        "Do not skip unit analysis."
    ),
    "PS": (
        "Answer the MCAT Psych/Soc question step by step.\n\n"
        "Rules:\n"
        "1. Identify the core psychological or sociological concept first.\n"
        "2. Determine whether the question is asking for a definition, application, or distinction between concepts.\n"
        "3. Extract the relevant clues from the passage/question.\n"
        "4. Match the clues to the best-fitting term or principle.\n"
        "5. Eliminate wrong choices briefly, especially close distractors.\n"
        "6. Give the final answer as a single option letter.\n\n"
        "Be concise but explicit."
    ),
}
DEFAULT_INSTRUCTIONS = (
    "Answer the MCAT question step by step.\n\n"
    "Rules:\n"
    "1. Identify the core concept.\n"
    "2. Extract the key details from the passage/question.\n"
    "3. Evaluate each answer choice.\n"
    "4. Eliminate wrong choices briefly.\n"
    "5. Give the final answer as a single option letter.\n\n"
    "Be concise but explicit."
)
