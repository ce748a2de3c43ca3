"""Rule packs: plain data that the rule expressions are built from.

All lists and patterns in this file are fixed values, given in their natural order. Patterns
are regular expressions, searched case-insensitively unless said otherwise. Alternatives that
could never match (broken escapes) are left out.
"""

# --- cleaning -------------------------------------------------------------------------------------
ZONE_LINES, LONGEST_RUNNING_LINE, RECURRING_RATIO = 3, 140, 0.35
PAGE_NUMBER = r"^(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?$"
TOC_LEADER = r"^.{2,160}?(?:\.{3,}|\s\.{2,}|\s*[\x{2026}\x{22ef}]{1,})\s*[ivxlcdm\d-]{1,8}$"
BIBLIOGRAPHY = (
    r"^(?:\d{1,3}\.\s+[A-Z][a-zA-Z\-]+(?:\s+[A-Z]{1,3})?|\bdoi\.org/|https?://(?:dx\.)?doi\.org/|\bPaediatr Respir Rev\b|"
    r"\bIndian Pediatr\b|\bEur J Emerg Med\b|\bPediatr Pulmonol\b|\bN Engl J Med\b|\bLancet\b|\bBMJ\b|\bJ Allergy Clin Immunol\b)"
)
BIBLIOGRAPHY_PROOF = r"doi\.org|https://|^\d{1,3}\.\s+[A-Z]"
PROTECTED = (
    r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|kg|mL|L|IU|units?|mmol|mEq|mg/dL|mg/kg|mmHg|bpm|%)\b|\brecommendation\s+\d+[a-z]?\b|"
    r"\bgrade\s+[A-D]\b|\blevel\s+(?:I{1,3}|IV|V)\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{4}\b"
)
NAVIGATION = ["back to top", "click here", "home", "next", "previous", "return to recommendations"]

# --- chunking -------------------------------------------------------------------------------------
NUMBERED_HEADING = r"^(?:\d+(?:\.\d+)?\.?|section\s+\d+|chapter\s+\d+|part\s+[ivx\d]+)\s+\S"
NAMED_HEADING = r"^(?:recommendation|recommendations|appendix|annex)(?:\s+\d+[\.\d+]*)?:?$"
TOPIC_HEADING = (
    r"^(?:summary of recommendations|initial (?:clinical|management|treatment)|diagnosing\b|monitoring\b|pharmacological\b|"
    r"self-management\b|medicines for\b|management of\b|treatment of\b|recommendations for research\b|"
    r"how the recommendations might affect practice\b|rationale and impact\b)"
)
ADMINISTRATIVE = [
    r"\bfunding\b", r"\backnowledg?ments?\b", r"\bisbn\b", r"\bsome\s+rights\s+reserved\b", r"\bcataloguing-in-publication\b",
    r"\bdeclaration\s+of\s+interests?\b", r"\bannex\s+1\.\s+management\s+of\s+conflicts\b",
]
CHUNK_SIZE, CHUNK_OVERLAP, SHORTEST_CHUNK, LEAST_LETTERS = 700, 100, 100, 0.40

# --- retrieval ------------------------------------------------------------------------------------
K1, B, RRF_K = 1.5, 0.75, 60
RERANK_OVERLAP, RERANK_SCORE, RERANK_PHRASE = 0.55, 0.25, 0.35
ACRONYMS = {
    "eib": "exercise-induced bronchoconstriction", "feno": "fractional exhaled nitric oxide", "ics": "inhaled corticosteroids",
    "saba": "short-acting beta2-agonist", "laba": "long-acting beta2-agonist", "aerd": "aspirin-exacerbated respiratory disease",
    "fev1": "forced expiratory volume in 1 second", "pef": "peak expiratory flow", "ocs": "oral corticosteroids",
}
TYPOS = {
    "anad": "and", "asmtha": "asthma", "astma": "asthma", "asthmaa": "asthma", "symtoms": "symptoms", "symtom": "symptom",
    "treament": "treatment", "inhalrr": "inhaler", "bronkiolitis": "bronchiolitis", "spiroemtry": "spirometry",
    "veentolin": "ventolin", "salbutamoll": "salbutamol", "budesonidd": "budesonide",
    "بخاخخ": "بخاخ", "سترويد": "ستيرويد", "فنتولينن": "فنتولين", "ربوو": "ربو", "اعراضض": "أعراض",
}
FUZZY_CUTOFF, FUZZY_LETTERS = 0.82, 5

# --- grounding ------------------------------------------------------------------------------------
STOPWORDS_EN = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "for", "and", "or", "with",
    "as", "by", "this", "that", "these", "those", "it", "its", "should", "may", "can", "could", "will", "would", "has", "have",
    "had", "not", "no",
]
STOPWORDS_AR = [
    "من", "في", "على", "الى", "إلى", "عن", "و", "أو", "او", "هذا", "هذه", "ذلك", "التي", "الذي", "لا", "لم", "قد", "كان", "يكون", "مع",
]
CLAIM_RATIO, CLAIM_TERMS = 0.25, 1
HIGH, MODERATE, REFUSE_BELOW, EVIDENCE_FLOOR, EVIDENCE_GAP = 0.80, 0.60, 0.55, 0.32, 0.18
DOSAGE = r"\b\d+\s*(mg|mcg|µg|ml|units?)\b"

# --- gate -----------------------------------------------------------------------------------------
EMERGENCY = [
    r"\bcan\s*'?t\s+breathe\b", r"\bcannot\s+breathe\b", r"\bnot\s+breathing\b", r"\bstopped\s+breathing\b", r"\bturning\s+blue\b",
    r"\bblue\s+lips\b", r"\blips?\s+(are\s+)?blue\b", r"\bunconscious\b", r"\bunresponsive\b", r"\bpassed\s+out\b", r"\bcollapsed\b",
    r"\bsevere\s+difficulty\s+breathing\b", r"\bstruggling\s+to\s+breathe\b", r"\bgasping\s+for\s+air\b",
    r"\bchest\s+(is\s+)?(very\s+)?tight.{0,20}(can'?t|cannot|struggling)\b", r"\bemergency\b.{0,20}\bnow\b",
    r"\bcall\s+(an\s+)?ambulance\b", r"\b911\b|\b999\b|\b112\b",
    r"وقف(ت)?\s+ال?تنفس", r"مش\s+قادر\s+يتنفس", r"مش\s+قادره?\s+تتنفس", r"مبي?قدرش?\s+يتنفس", r"بيتلون\s+ب?الأزرق", r"شفاي?فه?\s+زرقاء?",
    r"وشه?\s+ب?يزرق", r"فاقد\s+الوعي", r"مش\s+واعي", r"غايب\s+عن\s+الوعي", r"وقع\s+ومش\s+بيرد", r"صعوبة\s+شديدة\s+في\s+ال?تنفس", r"مختنق",
    r"اتصل(و)?\s+بال?إسعاف", r"طوارئ\s+دلوقتي", r"حالة\s+خطيرة\s+دلوقتي",
]
RED_FLAGS = [
    r"\b(blue|cyanosis|turning blue|blue lips|blue face)\b",
    r"\b(can'?t breathe|cannot breathe|gasping|stopped breathing|suffocating|struggling to breathe)\b",
    r"\b(unconscious|unresponsive|collapsed|passed out|fainted|seizure|convulsion)\b",
    r"\b(silent chest|exhaustion|drowsy|extreme lethargy|stridor at rest)\b",
    r"أنقذوني|طفلي\s+لا\s+يتنفس|ازرقاق|اختناق|صعوبة\s+شديدة\s+في\s+التنفس|بموت|انا\s+بموت|أنا\s+بموت|مش\s+قادر\s+اتنفس|شفايفه\s+زرقاء|فاقد\s+الوعي",
]
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|prompt)",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|prompt)",
    r"forget\s+(all\s+)?(previous|prior|your)\s+(instructions?|rules?|prompt)", r"you\s+are\s+now\s+(a|an)\b", r"act\s+as\s+(a|an|if)\b",
    r"pretend\s+(to\s+be|you\s+are)\b", r"new\s+instructions?\s*:", r"system\s+prompt", r"reveal\s+your\s+(system\s+)?prompt",
    r"show\s+me\s+your\s+(instructions?|prompt|rules)", r"what\s+are\s+your\s+(instructions?|rules|guidelines)\b",
    r"do\s+not\s+follow\s+(the|your)\s+(rules?|guidelines?|instructions?)", r"bypass\s+(the\s+)?(safety|rules?|restrictions?|filters?)",
    r"jailbreak", r"dan\s+mode", r"developer\s+mode", r"override\s+(the\s+)?(rules?|instructions?|safety)",
    r"from\s+now\s+on\s+you\s+(will|must|shall)\b", r"respond\s+only\s+with\s+.{0,20}(uncensored|unfiltered|no\s+restrictions?)",
    r"تجاهل\s+(كل\s+)?(التعليمات|الأوامر)\s+(السابقة|اللي\s+فاتت)", r"انسى\s+(كل\s+)?(التعليمات|الأوامر|القواعد)", r"انت\s+دلوقتي\s+(هتبقى|بقيت)",
    r"تصرف\s+وكأنك\b", r"اعمل\s+نفسك\b", r"تعليمات\s+جديدة\s*:", r"system\s*prompt", r"وريني\s+ال?تعليمات\s+بتاعتك", r"اظهر\s+ال?system\s*prompt", r"من\s+دلوقتي\s+هتبقى",
]
OFF_TOPIC = [
    r"\bbreast\s+cancer\b", r"\bcancer\s+screening\b", r"\bdiabetes\b", r"\bhypertension\b", r"\bheart\s+attack\b", r"\bcar\s+engine\b",
    r"\bice\s+cream\b", r"\bgambary\b|\bgambari\b", r"\bwho\s+(made|created|built)\s+you\b",
    r"^(hello|hi|hey|howdy|good\s+(morning|afternoon|evening))\b", r"\bfootball\b|\bsoccer\b", r"\brecipe\b",
    r"سرطان\s+الثدي", r"فحص\s+السرطان", r"السكري", r"ضغط\s+الدم", r"أزمة\s+قلبية", r"محرك\s+السيارة", r"آيس\s+كريم", r"جمبري|جمبرى", r"من\s+صنعك",
    r"مرحبا|أهلا|ازيك|ازيكـ",
]
#: Substrings, one of which a text in scope contains.
TOPIC_TERMS = [
    "asthma", "wheez", "inhaler", "bronch", "bronchiolitis", "ics", "saba", "laba", "mart", "feno", "spirometry", "peak flow",
    "exacerbation", "nebuliz", "controller", "reliever", "steroid", "allerg", "respirat", "lung", "breath", "cough", "chest tight",
    "gina", "who guideline", "nice", "dose", "dosage", "treatment", "medication", "therapy", "management", "symptom", "symptoms",
    "diagnos", "guideline", "guidelines",
    "ربو", "أزيز", "بخاخ", "شعب", "الشعيبات", "تنفس", "صدر", "كحه", "كحة", "حساسية", "رئة", "رئتين", "ازمة", "أزمة", "نفس", "جرعة", "علاج", "دواء", "إرشادات", "ارشاد",
]
PATIENT_SCENARIO = [
    r"\bmy\s+(child|son|daughter|patient|baby|kid|boy|girl|father|mother|relative)\b", r"\bi\s+have\s+been\s+coughing\b",
    r"\bmight\s+it\s+be\s+asthma\b", r"\bdo\s+i\s+have\s+asthma\b", r"\bcould\s+this\s+be\s+asthma\b",
    r"\bdiagnos(e|is)\s+(me|my|this|a\s+patient)\b", r"\b(prescribe|dose|dosage)\s+for\s+(me|my)\b",
    r"\bshould\s+i\s+(take|give|start|stop|use|increase|decrease)\b", r"\bweighing\s+\d+\s*(kg|lbs?)\b", r"\b\d+\s*(kg|lbs)\b",
    r"\bpatient\s+presenting\s+with\b",
]

# --- router ---------------------------------------------------------------------------------------
#: Prefixes of words.
POPULATION_DEPENDENT = [
    "treatment", "management", "dose", "dosage", "controller", "therapy", "medication", "first-line", "first line",
    "علاج", "جرعة", "دواء", "العلاج", "إدارة",
]
POPULATION_CONTEXT = [
    "child", "children", "kid", "pediatric", "paediatric", "infant", "toddler", "adult", "adults", "elderly", "pregnan", "age",
    "طفل", "أطفال", "رضيع", "بالغ", "بالغين", "كبار", "حامل", "عمر", "سن",
]
SHORT_QUERY_TOPICS = ["asthma", "ربو", "wheez", "أزيز", "inhaler", "بخاخ", "symptom", "symptoms"]
#: Matched from the start.
VAGUE = [
    r"^\s*(it|that|this|those|these)\b.{0,25}$", r"^\s*(what about|how about)\b.{0,25}$", r"^\s*(more|tell me more|explain)\s*\.?\s*$",
    r"^\s*(and\s+)?(the\s+)?dose\s*\??\s*$", r"^\s*(the\s+)?treatment\s*\??\s*$", r"^\s*(ده|دي|كده|زي\s+كده)\s*\??\s*$",
    r"^\s*(وايه\s+كمان|واكتر\s+من\s+كده)\s*\??\s*$", r"^\s*ال?جرعة\s*\??\s*$", r"^\s*ال?علاج\s*\??\s*$",
]

# --- intent ---------------------------------------------------------------------------------------
OVERRIDE = [
    r"\b(ignore|override|bypass|disregard|forget)\s+(all\s+)?(previous\s+)?(instructions|rules|guidelines|prompts|system)\b",
    r"\b(you\s+are\s+now|act\s+as)\s+(an?\s+)?(unrestricted|unfiltered|jailbroken|DAN|evil|god|hacker)\b", r"\bsystem\s+prompt\b",
    r"\breveal\s+(the\s+)?(system|hidden|internal)\s+(prompt|instructions)\b", r"\[\s*system\s*:\s*override\s*\]",
    r"تجاهل\s+(جميع\s+)?(التعليمات|القواعد|الإرشادات|الأوامر)", r"تجاوز\s+(نظام\s+)?(الأمان|الحماية|القيود)", r"أنت\s+الآن\s+(مساعد|نظام)",
    r"غير\s+مقيد|بدون\s+قواعد|بدون\s+قيود", r"اكتب\s+كـ\s*(حاك|دان|مساعد\s+غير\s+أخلاقي)", r"كشف\s+(التعليمات|الأوامر)\s+الداخلية",
]
PERSONAL_DOSING = [
    r"\bshould\s+i\s+(give|take|administer|use)\s+.*(second|third|another|extra|more)\s+(puff|dose)\b",
    r"\bgive\s+.*(second|third|extra)\s+(puff|dose)\b", r"\bhow\s+many\s+puffs?\s+should\s+i\s+(give|take)\s+.*(right\s+now|immediately)\b",
    r"\bcan\s+i\s+(double|triple)\s+the\s+dose\b", r"\bshould\s+i\s+give\s+.*(right\s+now|immediately)\b",
    r"هل\s+أعطي.*(جرعة|بخخة)\s+(ثانية|إضافية)\s+الآن", r"كم\s+بخخة\s+أعطي.*الآن",
]
AMBIGUOUS = [
    r"^(dose|dosage|treatment|medication|asthma|help|management)\??$", r"^what\s+is\s+the\s+dose\??$", r"^how\s+to\s+treat\s+it\??$",
    r"^ما\s+هي\s+الجرعة\??$", r"^كيف\s+نعالجه\??$",
]
AMBIGUOUS_WORDS = ["dose", "dosage", "treatment", "asthma", "reliever", "الربو", "الجرعة"]
EDUCATIONAL = [
    r"^what\s+is\s+asthma\??$", r"^how\s+does\s+asthma\s+affect\b", r"^explain\s+(the\s+)?(pathophysiology|definition|mechanism|guidelines?)\b",
    r"^what\s+(is|are)\s+(feno|ics|saba|laba|mart|fev1|pef|gina)\??$", r"^difference\s+between\s+ics\s+and\s+saba",
    r"^what\s+does\s+the\s+guideline\s+say\s+about\b",
]
MEDICATION = [
    r"\b(prescribe|dose|dosage|medication|drug|inhaler|ics|saba|laba|mart|salbutamol|fluticasone|budesonide|steroids?)\b",
    r"\bwhat\s+(medicine|drug|treatment|dose|inhaler)\s+should\b", r"\bwhat\s+treatment\s+do\s+you\s+recommend\b",
    r"\bhow\s+much\s+(ics|saba|salbutamol|dose)\b",
    r"\bshould\s+i\s+(start|give|take|use)\s+.*(budesonide|ics|saba|salbutamol|inhaler|steroids?|medication|treatment)\b",
    r"كم\s+جرعة|دواء|بخاخ|علاج|سولفات|اعطِ\s+طفلي",
]
DIAGNOSIS = [
    r"\bdo\s+i\s+have\s+asthma\b", r"\bcould\s+this\s+be\s+asthma\b", r"\bcould\s+it\s+be\s+asthma\b",
    r"\bwhy\s+do\s+i\s+(cough|wheeze|gasp)\b", r"\bcoughing\s+at\s+night\b", r"\bdiagnos(e|is)\s+(me|my|this|patient)\b",
    r"\bis\s+(coughing|wheezing)\s+a\s+sign\b", r"هل\s+عندي\s+ربو|تشخيص|لماذا\s+أسعل",
]
PATIENT_SPECIFIC = [
    r"\bshould\s+i\s+be\s+worried\b", r"\bmy\s+(child|son|daughter|patient|baby|kid|boy|girl|father|mother)\b",
    r"\bfor\s+my\s+(asthma|symptoms)\b", r"\bin\s+my\s+case\b", r"طفلي|ابني|حالتي|أشعر",
]
AGE_NEEDED = ["medication_or_dose_request", "general_medication_info"]
AGE_NAMES = {
    "under_6": ["under 6", "under-5", "infant", "toddler"],
    "children_6_11": ["6-11", "6 to 11"],
    "adults_adolescents": ["12+", "adult", "adolescent"],
}
CLASSIFIER_AGES = {
    "children_under_6": r"\b(toddler|infant|baby|[1-5]\s*(-|\s*to\s*)?(year|yr|yo|y/o)|under\s+6)\b",
    "children_6_11": r"\b(6|7|8|9|10|11)\s*(-|\s*to\s*)?(year|yr|yo|y/o)\b",
    "adults_adolescents": r"\b(adults?|adolescents?|teenagers?|teens?|12\+|>=12|1[2-9]\s*(-|\s*to\s*)?(year|yr|yo|y/o))\b",
}
QUERY_AGES = {
    "under_6": r"\b(under 6|under-5|infant|toddler|baby|2-year|3-year|4-year|5-year)\b",
    "children_6_11": r"\b(6-11|6 to 11|6–11|7-year|8-year|9-year|10-year|11-year)\b",
    "adults_adolescents": r"\b(12\+|adolescent|adult|adults|18-year)\b",
}
AGE_PHRASES = {
    "under_6": ("2-year-old child under 6", "under-5 age band, children under 6"),
    "children_6_11": ("9-year-old child aged 6 to 11", "age band children 6–11"),
    "adults_adolescents": ("adult aged 18", "age band 12+ adolescent adult"),
}
#: Concept and its Arabic patterns; of matching age concepts the last one counts.
CONCEPTS = {
    "asthma": ["ربو", "الربو", "حساسية الصدر", "حساسية صدر", "أزمة ربوية", "ازمة ربوية", "أزمات ربوية"],
    "symptoms": ["أعراض", "اعراض", "علامات", "تصفير", "أزيز", "ازيز", "كحة", "سعال", "ضيق تنفس", "كتمة"],
    "medication": ["علاج", "علاجات", "بخاخ", "بخاخات", "كورتيزون", "فنتولين", "سالبوتامول", "موسع شعب", "جرعة", "الجرعة"],
    "diagnosis": ["تشخيص", "فحص", "كيف اعرف", "طريقة الفحص"],
    "under_6": ["أطفال أقل من 6", "تحت 6", "اقل من 6", "رضيع", "رضع", "بيبي", "طفل صغير", "سنتين", "3 سنين", "4 سنين", "5 سنين"],
    "children_6_11": ["من 6 لـ 11", "من 6 الى 11", "6-11", "6–11", "7 سنين", "8 سنين", "9 سنين", "10 سنين"],
    "adults_adolescents": ["بالغ", "بالغين", "كبار", "كبير", "مراهق", "مراهقين", "12 سنة وفوق", "فوق 12"],
}

# --- dialogue -------------------------------------------------------------------------------------
NEW_TOPICS = [
    "diabetes", "copd", "pneumonia", "bronchiolitis", "hypertension", "covid", "cancer", "eczema", "fever", "arthritis", "heart",
    "headache", "السكري", "السكر", "الضغط", "كورونا", "التهاب رئوي", "السرطان", "الجلد", "الحرارة", "نزلة معوية",
]
FOLLOW_UP_EN = [r"\bit\b", r"\bthey\b", r"\bthat\b", r"\bthese\b", r"\bthose\b", r"\bthe second one\b", r"\bside effects\b", r"\bthe dosage\b", r"\bwhat about\b"]
FOLLOW_UP_AR = [
    "وما هي آثاره", "ما هي آثاره", "ما هي الجرعة", "وما هي الجرعة", "ماذا عن", "وماذا عن", "كيف يتم استخدامه", "كيف نستخدمه", "آثاره الجانبية",
    "اعراضه الجانبية", "طريقة استخدامه",
]
SUBJECTS = ["asthma", "ربو", "حساسية", "bronchiolitis"]
LEADING_WORDS = r"^(what|how|why|when|is|can|should|could)\s+(are|is|do|does|i|we|a|the)?\s*"
PRONOUNS = r"\b(it|that|this|these|those|they|second one)\b"

FOLLOW_UP_FORMS = [r"\bhow is it\b", r"\bwhat are its\b", r"\bhow to treat it\b", r"\bwhat about children\b", r"\bhow do you treat it\b", r"\bwhat about\b"]
#: Words of a follow-up and what is asked then; the first that holds.
FOLLOW_UP_QUESTIONS = [
    (["treatment", "treated", "manage"], "How is {} treated?"), (["symptom"], "What are the symptoms of {}?"), (["diagnos"], "How is {} diagnosed?"),
]
CHILD_TOPIC, TOPIC, CHILD_WORDS = "paediatric asthma", "asthma", ["paediatric", "child"]
TERSE = {
    "asthma symptoms": "What are the symptoms of asthma?", "paediatric asthma symptoms": "What are the symptoms of paediatric asthma?",
    "pediatric asthma symptoms": "What are the symptoms of paediatric asthma?", "asthma treatment": "How is asthma treated?",
    "paediatric asthma treatment": "How is paediatric asthma treated?", "pediatric asthma treatment": "How is paediatric asthma treated?",
    "asthma triggers": "What triggers asthma?", "asthma diagnosis": "How is asthma diagnosed?", "asthma management": "How is asthma managed?",
}

# --- decomposition --------------------------------------------------------------------------------
CONJUNCTIONS = r"\b(and|also|additionally|furthermore|moreover|plus|as well as|and also|what about|how about|in addition)\b"
STARTERS = r"\b(what|when|how|why|which|who|where|is|are|does|do|should|can|could|would|will|may|might|must)\b"
SPLITS = [
    r"(?i),\s*(?=(?:and\s+)?(?:what|when|how|why|which|who|where|is|are|does|do|should|can|could|would|will|may|might|must)\b)",
    r"\?\s+(?=[A-Z\x{0600}-\x{06FF}])",
    r"(?i)\band\s+(?=(?:what|when|how|why|which|who|where|is|are|does|do|should|can)\b)",
]
SHORTEST_QUESTION, COMPOUND_WORDS = 12, 8
NUMBERED_ITEM = r"(?:\r?\n|\s+)(?=(?:\d+|[\x{0660}-\x{0669}]+)[\.\)]\s+)"
NUMBER_PREFIX = r"^(?:\d+|[\x{0660}-\x{0669}]+)[\.\)]\s*"
SPLIT_AR = r",\s*|\s+(?=و\s*كيف|و\s*ما\s*هي|و\s*ما\s*هو|بالإضافة\s+إلى|بالاضافة\s+الى)"
SPLIT_EN = r"(?i),\s*(?=(?:and\s+)?(?:what|how|why|when|which|is|are|should|can)\b)|\band\s+(?=(?:what|how|why|when)\b)"
SHORTEST_PART = 8

# --- video ----------------------------------------------------------------------------------------
VIDEOS = {
    "breathing_exercise": [
        r"breathing\s+exercise", r"breathing\s+technique", r"how\s+do\s+i\s+breathe", r"pursed\s+lip\s+breathing",
        r"diaphragmatic\s+breathing", r"how\s+to\s+calm\s+my\s+breathing", r"breathing\s+timer",
        r"تمارين\s+التنفس", r"تمرين\s+تنفس", r"كيف\s+اتنفس", r"طريقة\s+التنفس", r"تهدئة\s+التنفس",
    ],
    "inhaler_technique": [
        r"how\s+to\s+use\s+an?\s+inhaler", r"inhaler\s+video", r"inhaler\s+technique", r"how\s+do\s+i\s+use\s+my\s+inhaler",
        r"breathilezer", r"breathalizer", r"breathalyzer", r"nebulizer\s+video", r"spacer\s+technique", r"spacer\s+video",
        r"طريقة\s+استخدام\s+البخاخ", r"فيديو\s+البخاخ", r"كيف\s+استخدم\s+البخاخ", r"استعمال\s+البخاخ", r"استخدام\s+البخاخ",
    ],
}

# --- keyword intent -------------------------------------------------------------------------------
OUT_OF_SCOPE_WORDS = [
    "joke", "weather", "poem", "song", "recipe", "game", "movie", "football", "soccer", "super bowl", "ignore previous", "forget all",
    "system prompt", "tell me a story", "who is the president", "capital of", "diabetes", "appendicitis", "cancer", "hypertension", "heart attack",
]
KEYWORD_INTENTS = {
    "PATIENT_SPECIFIC": ["my child", "my patient", "weighing", "prescribe"], "SYMPTOMS": ["symptom", "sign"],
    "TREATMENT": ["treat", "management", "medication"], "DIAGNOSIS": ["diagnos", "assess"],
}
TECHNIQUE_WORDS = ["technique", "step", "press", "breathe", "inhale", "mouthpiece", "hold breath", "actuation"]
PROCEDURE_WORDS = ["how to use", "technique", "steps to", "how do i use"]
DOSAGE_WORDS = ["dose", "dosage", "how much", "mg", "mcg"]

# --- standalone questions (fixed values): text looked for, pattern, question form ------------------
NARRATIVES_EN = [
    ("coughing at night", r"I keep coughing at night,?\s*could it be asthma\??", "Is nocturnal coughing a symptom of asthma?"),
    ("my child's asthma", r"my child's asthma", "pediatric asthma"),
    ("for my child", r"for my child's asthma", "for pediatric asthma"),
]
WHOLE_EN = [
    (["asthma symptoms", "symptoms of asthma"], "What are the common symptoms of asthma in children?"),
    (["asthma treatment", "treatment of asthma"], "How is pediatric asthma treated?"),
]
NARRATIVES_AR = [("طفلي بيكح", "السعال عند الأطفال"), ("أنا بكح", "السعال في الليل")]
WHOLE_AR = [
    (["أعراض الربو", "اعراض الربو", "أعراض حساسية الصدر"], "ما هي أعراض الربو عند الأطفال؟"),
    (["علاج الربو", "علاج حساسية الصدر"], "كيف يتم علاج الربو عند الأطفال؟"),
]
#: Least letters of a mapped term.
SHORTEST_TERM = 3

# --- prompt (fixed values) ------------------------------------------------------------------------
PROMPT_TURNS = 6
PROMPT_HISTORY = "RECENT CONVERSATION HISTORY:\n"
PROMPT_EVIDENCE = "EVIDENCE CHUNKS:\n"
PROMPT_QUESTION = "\n\nCLINICAL QUESTION:\n"
PROMPT_END = "\n\nAnswer using ONLY the evidence above. Follow the JSON structure exactly."
#: Where a typed text begins a numbered item, and the number itself.
TYPED_ITEM, TYPED_NUMBER = r"(?U)\s+(?=\d+[.)]\s)", r"(?U)^\d+[.)]\s*"
