"""Word lists, patterns and constants that results depend on."""

SCORE_WORDS_BASIC = [
    "university", "course", "program", "student", "fee", "admission", "registration", "semester", "exam", "grade",
    "professor", "dean", "policy", "requirement", "deadline", "application", "hostel", "library", "schedule", "timetable",
]
SCORE_WORDS_ENHANCED = [
    "university", "college", "course", "program", "student", "fee", "tuition", "admission", "registration", "semester",
    "exam", "grade", "professor", "dean", "policy", "requirement", "deadline", "application", "hostel", "library",
    "schedule", "timetable", "academic", "faculty", "department", "degree", "credit",
]
SCORE_WORDS_CHUNKER = [
    "university", "course", "program", "student", "fee", "admission", "registration", "semester", "exam", "grade",
    "professor", "dean", "policy", "requirement", "deadline", "application", "schedule",
]
CONTACT_PATTERNS = [
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\bwww\.[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{1,2}:\d{2}\s*(AM|PM|am|pm)?\b",
]
LIST_PATTERN = r"(\n\s*[-*•]\s+|\d+\.\s+)"

STRUCTURED_PATTERNS = {
    "time_query": [
        r"what time.*(?:class|lecture|lab)",
        r"when (?:is|does).*(?:start|begin|happen)",
        r"(?:start|begin|end) time.*(?:for|of)",
        r"schedule.*(?:for|of).*(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday)",
    ],
    "room_query": [
        r"(?:which|what) room.*(?:is|for)",
        r"where (?:is|does).*(?:class|lecture|lab)",
        r"location.*(?:of|for)",
        r"room.*(?:for|of)",
    ],
    "availability_query": [
        r"(?:which|what).*(?:room|class).*(?:free|available)",
        r"(?:free|available).*(?:room|at|during)",
        r"(?:empty|vacant).*room",
        r"room.*(?:available|free).*(?:at|during)",
    ],
    "instructor_query": [
        r"who (?:teaches|is teaching)",
        r"(?:teacher|instructor|lecturer).*(?:for|of)",
        r"taught by.*who",
        r"Dr\.?\s+\w+.*(?:teaches|class)",
    ],
    "class_schedule": [
        r"(?:schedule|timetable).*(?:for|of).*(?:BICS|class)",
        r"(?:BICS|class).*(?:\d[ABC]).*(?:schedule|timetable|class)",
        r"what (?:classes|subjects).*(?:does|has).*(?:BICS|\d[ABC])",
        r"(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday).*class",
    ],
    "subject_query": [
        r"(?:ICS|HED|MATH|STAT)\s*\d{4}",
        r"(?:object oriented|database|network|calculus|algebra).*(?:class|course)",
        r"when.*(?:object oriented|database|network|calculus|algebra)",
    ],
}
SCHEDULE_ENTITIES = [
    r"BICS\s+\d[ABC]",
    r"\d{1,2}[:\.]\d{2}(?:\s*[AP]M)?",
    r"(?:morning|afternoon|evening)",
    r"(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
    r"(?:LT|Lab|Room|MSB|SLS|STMB|Lecture Theatre)\s*\d*",
    r"(?:ICS|HED|MATH|STAT)\s*\d{4}",
    r"Dr\.?\s+[A-Z][a-z]+",
]
SEMANTIC_WORDS = [
    "explain", "definition", "what is", "how to", "why", "policy", "requirement", "procedure", "process", "admission",
    "fee", "cost", "payment", "scholarship", "facilities", "library", "accommodation", "housing", "club", "society",
    "event", "ceremony", "graduation",
]
NOW_PHRASES = ["now", "currently", "at the moment", "right now", "today", "this morning", "this afternoon", "this evening"]
TEMPORAL_SIGNALS = [
    "current", "latest", "recent", "today", "now", "right now", "this semester", "current semester", "this year",
    "deadline", "upcoming", "announcement", "news", "update", "how much", "exact amount", "specific",
]

INTENTS = [
    "factual_query", "procedural_query", "explanation_query", "comparison_query", "schedule_query", "fees_query", "admission_query",
    "navigation_query", "off_topic", "clarification", "feedback", "general_chat", "time_sensitive_query", "contextual_reference",
]
TOPICS = ["academics", "admissions", "fees", "facilities", "policies", "student_life", "events", "general", "schedule", "navigation", "other"]
GREETING = r"^(hi|hello|hey|greetings|howdy|good\s+(morning|afternoon|evening))\b"
FEEDBACK = r"\b(thank(s|\s+you)|appreciate|helpful|makes\s+sense|understood|got\s+it|good\s+answer)\b"
#: Intent, topic and words, in order of precedence.
INTENT_WORDS = [
    ("schedule_query", "schedule", ["timetable", "schedule", "class today", "lecture today", "upcoming class", "what time is", "when does class"]),
    ("fees_query", "fees", ["fee", "tuition", "cost", "payment", "scholarship", "bursary", "how much"]),
    ("admission_query", "admissions", ["admission", "apply", "application", "entry requirement", "enroll"]),
    ("navigation_query", "navigation", ["where is", "location of", "how do i get to", "which building", "directions to"]),
    ("procedural_query", "general", ["how do", "how to", "steps to", "procedure for", "process of"]),
    ("explanation_query", "general", ["why", "explain", "reason", "elaborate", "what does it mean"]),
    ("comparison_query", "general", ["compare", "difference between", "versus", " vs ", "better", "advantage"]),
]
NEEDS_CONTEXT = ["clarification", "contextual_reference", "explanation_query"]

PRONOUNS = ["he", "she", "they", "him", "her", "them", "his", "hers", "their", "it", "its"]
VAGUE_WORDS = ["this", "that", "these", "those", "predecessor", "successor", "same", "similar"]
FOLLOW_UPS = ["what about", "tell me more about", "more about", "elaborate on"]
COURSE_CODE = r"\b[A-Z]{2,5}\s*\d[\d.]*[A-Z]?\b"
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"

SCHEDULE_INDICATORS = [
    r"[A-Z]{2,6}\s+\d[A-Z].*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec).*20\d{2}",
    r"\d{1,2}[:\.]\d{2}[-–]\d{1,2}[:\.]\d{2}",
    r"(?:Monday|Tuesday|Wednesday|Thursday|Friday)",
    r"(?:LT|Lab|Room|MSB|SLS|STMB|Lecture Theatre)",
    r"(?:ICS|HED|MATH|STAT)\s*\d{4}",
    r"Dr\s+[A-Z][a-z]+",
]
TIME_RANGE = r"(\d{1,2})[:.](\d{2})\s*[-–]\s*(\d{1,2})[:.](\d{2})"
ROOM_PATTERNS = [r"LT\s*\d+", r"Lecture\s+Theatre\s+\d+", r"Lab\s*\d+", r"MSB\s+\d+", r"SLS\s+\w+", r"STMB\s+[\w\d\s]+", r"Room\s+\d+", r"RM\s+\d+"]
UNIT_CODE = r"\b([A-Z]{2,5}\s*\d{3,4})\b"
INSTRUCTOR = r"(?i)Dr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"

#: Words that start each group of query expansions, and what is appended.
EXPANSIONS = [
    (["fee", "cost", "payment", "tuition"], ["payment schedule deadline", "scholarship financial aid"]),
    (["admission", "apply", "entry"], ["requirements qualifications", "application process procedure"]),
    (["class", "schedule", "timetable"], ["semester academic calendar", "lecture tutorial lab"]),
    ([], ["policy procedure", "student guide information"]),
]
TOPIC_PHRASES = {
    "fees": "tuition fees payment schedule", "admission": "admission requirements entry qualifications", "schedule": "class timetable semester calendar",
    "events": "university events announcements", "facilities": "campus facilities services", "policies": "university policies regulations",
    "academic": "academic programs courses degrees",
}
WEB_WORDS = ["university", "student", "academic", "campus"]
#: Chunk size, overlap and similarity threshold.
PRESETS = {"production": (1000, 200, 0.92), "development": (200, 10, 0.90), "research": (1200, 300, 0.85), "memory_optimized": (600, 100, 0.95)}
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
#: File extension and kind of document.
EXTENSIONS = {
    ".txt": "text", ".md": "markdown", ".csv": "csv", ".json": "json", ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".xlsx": "xlsx", ".xls": "xls",
    ".pptx": "pptx", ".ppt": "ppt", ".html": "html", ".htm": "html", ".xml": "xml", ".eml": "email",
}
#: Words too common to be terms of the lexical index.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until "
    "up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()
