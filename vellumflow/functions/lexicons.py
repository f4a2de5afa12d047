"""Word lists, lookup tables and patterns that the results depend on. Other tables can be passed to the operators instead."""

from __future__ import annotations

# Role heuristics.
DOCTOR_KEYWORDS = (
    "assessment", "plan", "follow up", "follow-up", "differential", "start you on", "i recommend", "i'll prescribe", "i will prescribe", "prescribe", "dose", "mg", "b.i.d", "bid", "t.i.d", "tid", "q.d", "qd",
    "referral", "imaging", "x-ray", "ct", "mri", "ultrasound", "labs", "cbc", "cmp", "a1c", "lipid", "troponin", "blood pressure", "bp", "heart rate", "hr", "respiratory rate", "rr", "spo2", "oxygen",
    "physical exam", "on exam", "exam", "auscultation", "palpation", "contraindicated", "indicated", "guideline", "screening", "uspstf", "nice",
)
DOCTOR_IMPERATIVES = ("take", "start", "stop", "begin", "increase", "decrease", "schedule", "follow", "avoid", "return", "monitor", "check", "continue")
DOSAGE = r"\b\d+(\.\d+)?\s*mg\b"
DOCTOR_PHRASES = ("we'll", "let's", "i recommend")

# Questions and answers.
QUESTION_CUES = ("do you", "are you", "have you", "when", "where", "how", "why", "did you", "does it", "is there", "can you", "would you", "any ")
BACKCHANNELS = ("uh", "uh-huh", "mm", "mm-hmm", "okay", "ok", "alright", "right", "got it", "yep", "yeah", "yup", "hmm", "huh", "mmm", "sure", "yes", "no")

# Questions to leave out, questions that matter, and parts of the body and signs that make a question matter.
SKIPPED_QUESTIONS = (
    r"(?:how|what)\s+(?:is|are)\s+(?:your\s+)?(?:name|age|address|phone|insurance)", r"(?:can|could)\s+(?:you|I)\s+(?:see|have|get)\s+(?:your|an|a)\s+(?:id|card|insurance)", r"(?:date\s+of\s+birth|birthday|dob)",
    r"(?:emergency\s+contact|next\s+of\s+kin)", r"(?:pharmacy|pharmacist)", r"(?:appointment|schedule|follow.?up)", r"(?:questions?\s+for\s+me|anything\s+else)",
)
CLINICAL_QUESTIONS = (
    r"(?:do|does|are|is|have|has)\s+(?:you|it|the)\s+(?:have|had|having|feel|felt|feeling|experience|experienced)", r"(?:how|what)\s+(?:long|often|much|many|severe)", r"(?:when|where)\s+(?:did|does|do)\s+(?:it|you|the|this)",
    r"(?:any|some)\s+(?:pain|symptoms?|problems?|issues?|trouble|difficulty)", r"(?:does|do)\s+(?:anything|it)\s+(?:make|help|worsen|improve)", r"(?:what|which)\s+(?:makes?|triggers?|causes?|helps?)",
    r"(?:have|has)\s+(?:you|anyone)\s+(?:ever|been|had)", r"(?:any|family)\s+(?:history|medical)", r"(?:previous|past|prior)\s+(?:surgery|surgeries|procedures?|hospitalizations?)", r"(?:diagnosed|told)\s+(?:you\s+)?(?:have|had|with)",
    r"(?:what|which)\s+(?:medications?|medicines?|drugs?|pills?)", r"(?:are|were)\s+(?:you|they)\s+(?:taking|on|prescribed)", r"(?:any|some)\s+(?:medications?|allergies)", r"(?:do|did)\s+(?:you|it)\s+(?:take|try|use)",
    r"(?:do|did)\s+you\s+(?:smoke|drink|exercise|use)", r"(?:how\s+)?(?:much|many|often)\s+(?:do|did)\s+you", r"(?:can|could|able)\s+(?:you|to)\s+(?:walk|sleep|eat|work|function)", r"(?:affect|impact|interfere)\s+(?:your|with|daily)",
)
QUESTION_PARTS = ("chest", "head", "stomach", "back", "leg", "arm", "heart", "lung", "kidney", "liver", "pain", "ache", "swell", "numb", "tingle", "bleed", "burn", "itch")

# Greetings and chief complaints.
GREETINGS = (
    r"^(?:hi|hello|hey|good (?:morning|afternoon|evening))[\s,\.!]*", r"^(?:nice|good|great) to (?:see|meet) you", r"^how(?:'re| are) you", r"^i(?:'m| am) (?:doing )?(?:good|well|fine|okay|ok)",
    r"^thank(?:s| you)", r"^yes[\s,\.]*(?:hi|hello)?", r"^(?:okay|ok|alright|sure)[\s,\.]*$",
)
COMPLAINT_CUES = (
    r"i(?:'m| am) here (?:because|for|to)", r"i came in (?:because|for|to|due to)", r"i(?:'ve| have) been having", r"i(?:'ve| have) been experiencing", r"i(?:'ve| have) got",
    r"my (?:main |chief )?(?:complaint|concern|problem|issue) is", r"what(?:'s| is) (?:bothering|troubling) me is", r"i(?:'m| am) (?:worried|concerned) about", r"i need help with",
    r"i(?:'m| am) having (?:trouble|problems?) with", r"i(?:'ve| have) noticed", r"recently i(?:'ve| have)", r"for the past", r"i woke up with", r"started (?:having|feeling|experiencing)",
)
SYMPTOM_INDICATORS = (
    r"\b(?:pain|ache|hurt|sore|tender)\b", r"\b(?:cough|sneez|wheez|breath)\b", r"\b(?:nausea|vomit|dizz|faint)\b", r"\b(?:tired|fatigue|weak|exhaust)\b", r"\b(?:fever|chill|sweat)\b",
    r"\b(?:itch|rash|swell|bump)\b", r"\b(?:can(?:'t|not) (?:sleep|eat|breathe|walk))\b", r"\b(?:trouble|difficulty|problem)\b", r"\b(?:worse|better|constant|intermittent)\b",
)

# Symptom patterns and names, in order.
SYMPTOMS = (
    (r"\b(?:chest\s+)?pain\b", "chest pain"), (r"\bheadache\b", "headache"), (r"\b(?:head\s+)?(?:hurt|hurts|hurting)\b", "headache"), (r"\bback\s*(?:pain|ache)\b", "back pain"),
    (r"\babdominal?\s*(?:pain|cramp)s?\b", "abdominal pain"), (r"\bstomach\s*(?:pain|ache|cramp)s?\b", "abdominal pain"), (r"\bjoint\s*(?:pain|ache)s?\b", "joint pain"), (r"\bmuscle\s*(?:pain|ache)s?\b", "muscle pain"), (r"\bsore\s+throat\b", "sore throat"),
    (r"\b(?:short(?:ness)?|difficult[yi]?)\s*(?:of\s+)?breath(?:ing)?\b", "shortness of breath"), (r"\bcan(?:'t|not)\s+(?:catch\s+(?:my\s+)?breath|breathe)\b", "shortness of breath"), (r"\bcough(?:ing)?\b", "cough"), (r"\bwheez(?:e|ing)\b", "wheezing"),
    (r"\bcongestion\b", "congestion"), (r"\brunny\s+nose\b", "rhinorrhea"), (r"\bstuffy\s+nose\b", "nasal congestion"),
    (r"\bnausea(?:ted)?\b", "nausea"), (r"\bvomit(?:ing|ed)?\b", "vomiting"), (r"\bthrow(?:ing)?\s+up\b", "vomiting"), (r"\bdiarrhea\b", "diarrhea"), (r"\bconstipat(?:ed|ion)\b", "constipation"), (r"\bheartburn\b", "heartburn"),
    (r"\bacid\s+reflux\b", "acid reflux"), (r"\bindigestion\b", "indigestion"), (r"\bbloat(?:ed|ing)\b", "bloating"), (r"\bloss\s+of\s+appetite\b", "decreased appetite"), (r"\bno\s+appetite\b", "decreased appetite"),
    (r"\bdizz(?:y|iness)\b", "dizziness"), (r"\blightheaded(?:ness)?\b", "lightheadedness"), (r"\bfaint(?:ing|ed)?\b", "syncope"), (r"\bpass(?:ed|ing)?\s+out\b", "syncope"), (r"\bnumb(?:ness)?\b", "numbness"), (r"\btingl(?:e|ing)\b", "tingling"),
    (r"\btremor\b", "tremor"), (r"\bshak(?:y|ing)\b", "tremor"), (r"\bseizure\b", "seizure"), (r"\bconfus(?:ed|ion)\b", "confusion"), (r"\bmemory\s+(?:loss|problems?)\b", "memory impairment"),
    (r"\bfever\b", "fever"), (r"\bchills?\b", "chills"), (r"\bnight\s+sweats?\b", "night sweats"), (r"\bfatigue[d]?\b", "fatigue"), (r"\btired(?:ness)?\b", "fatigue"), (r"\bexhaust(?:ed|ion)\b", "fatigue"), (r"\bweak(?:ness)?\b", "weakness"),
    (r"\bweight\s+(?:loss|gain)\b", "weight change"), (r"\blost\s+(?:some\s+)?weight\b", "weight loss"), (r"\bgained?\s+(?:some\s+)?weight\b", "weight gain"),
    (r"\binsomnia\b", "insomnia"), (r"\bcan(?:'t|not)\s+sleep\b", "insomnia"), (r"\btrouble\s+sleep(?:ing)?\b", "insomnia"), (r"\bsleep\s+(?:problem|difficult|issue)s?\b", "sleep disturbance"),
    (r"\brash\b", "rash"), (r"\bitch(?:y|ing)?\b", "pruritus"), (r"\bswell(?:ing|ed)?\b", "swelling"), (r"\bedema\b", "edema"), (r"\bruise[ds]?\b", "bruising"), (r"\bbleed(?:ing)?\b", "bleeding"),
    (r"\bpalpitation[s]?\b", "palpitations"), (r"\bheart\s+(?:racing|pounding|flutter)\b", "palpitations"), (r"\birregular\s+heart\s*beat\b", "irregular heartbeat"),
    (r"\bfrequent\s+urinat(?:ion|ing)\b", "urinary frequency"), (r"\bburn(?:ing|s)?\s+(?:when|during)\s+(?:I\s+)?(?:pee|urinat)\b", "dysuria"), (r"\bpain(?:ful)?\s+urinat(?:ion|ing)\b", "dysuria"), (r"\bblood\s+in\s+(?:my\s+)?urine\b", "hematuria"),
    (r"\banxi(?:ety|ous)\b", "anxiety"), (r"\bdepress(?:ed|ion)\b", "depression"), (r"\bstress(?:ed)?\b", "stress"), (r"\bpanic\s+attack\b", "panic attacks"),
)

# Drug names.
DRUGS = (
    "ibuprofen", "advil", "motrin", "naproxen", "aleve", "aspirin", "tylenol", "acetaminophen", "excedrin", "celebrex", "meloxicam", "lisinopril", "losartan",
    "amlodipine", "metoprolol", "atenolol", "carvedilol", "hydrochlorothiazide", "hctz", "furosemide", "lasix", "spironolactone", "atorvastatin", "lipitor",
    "simvastatin", "zocor", "rosuvastatin", "crestor", "pravastatin", "warfarin", "coumadin", "eliquis", "apixaban", "xarelto", "rivaroxaban", "plavix", "clopidogrel",
    "nitroglycerin", "metformin", "glucophage", "glipizide", "glyburide", "glimepiride", "insulin", "lantus", "humalog", "novolog", "ozempic", "trulicity", "jardiance",
    "farxiga", "invokana", "albuterol", "proventil", "ventolin", "advair", "symbicort", "breo", "spiriva", "singulair", "montelukast", "prednisone", "fluticasone",
    "flonase", "cetirizine", "zyrtec", "loratadine", "claritin", "diphenhydramine", "benadryl", "fexofenadine", "allegra", "omeprazole", "prilosec", "pantoprazole",
    "protonix", "nexium", "esomeprazole", "famotidine", "pepcid", "ranitidine", "zantac", "sucralfate", "carafate", "ondansetron", "zofran", "metoclopramide", "reglan",
    "docusate", "colace", "miralax", "polyethylene glycol", "loperamide", "imodium", "sertraline", "zoloft", "fluoxetine", "prozac", "escitalopram", "lexapro",
    "citalopram", "celexa", "paroxetine", "paxil", "venlafaxine", "effexor", "duloxetine", "cymbalta", "bupropion", "wellbutrin", "trazodone", "mirtazapine", "remeron",
    "alprazolam", "xanax", "lorazepam", "ativan", "clonazepam", "klonopin", "diazepam", "valium", "buspirone", "buspar", "quetiapine", "seroquel", "aripiprazole",
    "abilify", "risperidone", "risperdal", "olanzapine", "zyprexa", "lithium", "levothyroxine", "synthroid", "armour thyroid", "methimazole", "tapazole", "amoxicillin",
    "augmentin", "azithromycin", "zithromax", "z-pack", "ciprofloxacin", "cipro", "levofloxacin", "levaquin", "doxycycline", "metronidazole", "flagyl", "clindamycin",
    "sulfamethoxazole", "bactrim", "nitrofurantoin", "macrobid", "cephalexin", "keflex", "zolpidem", "ambien", "eszopiclone", "lunesta", "melatonin", "gabapentin",
    "neurontin", "pregabalin", "lyrica", "tramadol", "cyclobenzaprine", "flexeril", "methocarbamol", "robaxin", "sumatriptan", "imitrex", "topiramate", "topamax",
    "finasteride", "propecia", "tamsulosin", "flomax", "sildenafil", "viagra", "tadalafil", "cialis", "vitamin d", "vitamin b12", "folic acid", "iron", "calcium",
    "fish oil", "omega-3", "multivitamin", "probiotics",
)
DRUG_CONTEXT = (r"\b(?:tak(?:e|ing|en)|on|use|using|prescribed|started?|stopped?|quit)\b", r"\b(?:mg|milligram|mcg|microgram)\b", r"\b(?:daily|twice|once|every|morning|evening|night|bedtime)\b", r"\b(?:pill|tablet|capsule|medication|medicine|drug|prescription)\b")
#: name, code, generic
DRUG_ALIASES = (
    ("ibuprofen", "5640", "ibuprofen"), ("advil", "5640", "ibuprofen"), ("motrin", "5640", "ibuprofen"), ("acetaminophen", "161", "acetaminophen"), ("tylenol", "161", "acetaminophen"), ("paracetamol", "161", "acetaminophen"),
    ("albuterol", "435", "albuterol"), ("ventolin", "435", "albuterol"), ("salbutamol", "435", "albuterol"), ("amoxicillin", "723", "amoxicillin"), ("augmentin", "856836", "amoxicillin-clavulanate"),
    ("amoxicillin-clavulanate", "856836", "amoxicillin-clavulanate"), ("penicillin", "7981", "penicillin"),
)

# Vitals (kind and pattern, group 1 is the value) and attributes.
VITALS = (
    ("temp", r"\b(?:t(?:emp(?:erature)?)?)\s*[:=]?\s*(\d{2}(?:\.\d)?)\s*°?\s*([CF])?\b"), ("hr", r"\b(?:hr|heart\s*rate)\s*[:=]?\s*(\d{2,3})\b"), ("bp", r"\b(?:bp|blood\s*pressure)\s*[:=]?\s*(\d{2,3}\s*/\s*\d{2,3})\b"),
    ("rr", r"\b(?:rr|resp(?:iratory)?\s*rate)\s*[:=]?\s*(\d{2})\b"), ("spo2", r"\b(?:spo2|o2\s*saturation)\s*[:=]?\s*(\d{2})%\b"),
)
ATTRIBUTES = (
    ("duration", r"\b(?:for|x)\s*(\d+\s*(?:d(?:ays?)?|w(?:eeks?)?|mo(?:nths?)?|y(?:ears?)?))\b"), ("severity", r"\b(mild|moderate|severe)\b"), ("onset", r"\b(sudden|gradual|acute|chronic|subacute)\b"),
    ("dose", r"\b(\d+\.?\d*\s*(?:mg|mcg|g|ml|units))\b"), ("freq", r"\b(q\d+h|daily|qd|bid|tid|qid|qhs|prn|once daily|twice daily|every\s*\d+\s*(?:h|hours?))\b"),
    ("route", r"\b(po|oral|inh|inhal(?:er)?|iv|im|subcut|sq|sc|topical|sl)\b"), ("form", r"\b(tab(?:let)?|cap(?:sule)?|inhaler|syrup|suspension|cream|ointment|solution|spray)\b"), ("prn", r"\b(prn)\b"),
)
NEGATIONS = ("no", "not", "denies", "without", "never")
UNCERTAINTIES = ("possible", "consider", "?", "likely", "unlikely", "rule out", "r/o")
RISK_FACTORS = ("smoker", "smoking", "vape", "alcohol", "pregnant", "obese", "overweight", "diabetic")
ALLERGY = r"allerg(?:y|ic)\s*to\s+([a-zA-Z0-9\- ]+)"
REACTION = r"\b(rash|hives|swelling|anaphylaxis|itching|SOB)\b"
STOPPED = ("stopped", "quit", "no longer", "used to")

# Normal forms.
DOSE_UNITS = {"milligram": "mg", "milligrams": "mg", "microgram": "mcg", "micrograms": "mcg", "ug": "mcg", "gram": "g", "grams": "g", "milliliter": "ml", "milliliters": "ml", "cc": "ml", "unit": "units", "iu": "units", "percent": "%"}
FREQUENCIES = {
    "once_daily": ("qd", "od", "q24h", "every day", "daily", "once a day", "1x daily", "once daily", "one time daily", "every 24 hours"),
    "twice_daily": ("bid", "twice a day", "2x daily", "twice daily", "two times daily"),
    "three_times_daily": ("tid", "three times a day", "3x daily", "three times daily"),
    "four_times_daily": ("qid", "four times a day", "4x daily", "four times daily"),
    "every_4_hours": ("q4h", "every 4 hours", "every_4_hours"),
    "every_6_hours": ("q6h", "every 6 hours", "every_6_hours"),
    "every_8_hours": ("q8h", "every 8 hours", "every_8_hours"),
    "every_12_hours": ("q12h", "every 12 hours", "every_12_hours"),
    "as_needed": ("prn", "as needed", "as-needed", "when needed", "on an as needed basis", "as_needed", "as necessary"),
    "at_bedtime": ("qhs", "at bedtime", "at night", "before bed", "nightly", "at_bedtime", "bedtime", "hs"),
    "in_morning": ("qam", "in the morning", "morning", "in_morning", "every morning"),
    "once_weekly": ("weekly", "once weekly", "once a week", "once_weekly", "every week"),
    "twice_weekly": ("twice weekly", "twice a week", "twice_weekly", "2x weekly"),
}
DURATIONS = {"yesterday": "1_day", "since yesterday": "1_day", "today": "1_day", "a few days": "few_days", "couple days": "few_days", "a few weeks": "few_weeks", "couple weeks": "few_weeks"}
ASSERTIONS = {"present": ("present", "yes", "true", "current", "active", "confirmed"), "absent": ("absent", "no", "false", "denied", "denies", "negative"), "possible": ("possible", "maybe", "uncertain", "suspected", "likely")}
SEXES = {"male": ("m", "male", "man", "boy"), "female": ("f", "female", "woman", "girl")}
RACES = {"african american": "african_american", "african-american": "african_american", "black": "african_american", "white": "caucasian", "caucasian": "caucasian", "hispanic": "hispanic", "latino": "hispanic", "latina": "hispanic", "asian": "asian", "pacific islander": "pacific_islander", "native american": "native_american", "american indian": "native_american", "mixed": "mixed", "multiracial": "mixed"}
ORIENTATIONS = {"straight": "heterosexual", "heterosexual": "heterosexual", "gay": "homosexual", "lesbian": "homosexual", "homosexual": "homosexual", "bisexual": "bisexual", "bi": "bisexual", "queer": "queer", "pansexual": "pansexual", "asexual": "asexual"}
NULL_WORDS = ("null", "none", "unknown", "not specified", "not stated", "")
ALLERGENS = (
    "penicillin", "amoxicillin", "ampicillin", "penicillins", "sulfa", "sulfamethoxazole", "sulfasalazine", "sulfonamides", "erythromycin", "azithromycin",
    "clarithromycin", "macrolides", "tetracycline", "doxycycline", "minocycline", "cephalosporins", "cephalexin", "ceftriaxone", "cefdinir", "fluoroquinolones",
    "ciprofloxacin", "levofloxacin", "moxifloxacin", "vancomycin", "metronidazole", "trimethoprim", "nitrofurantoin", "clindamycin", "gentamicin", "aspirin", "nsaids",
    "ibuprofen", "naproxen", "celecoxib", "codeine", "morphine", "hydrocodone", "oxycodone", "tramadol", "fentanyl", "opioids", "acetaminophen", "tylenol",
    "ace_inhibitors", "lisinopril", "enalapril", "statins", "atorvastatin", "simvastatin", "contrast_dye", "iodine", "iodinated_contrast", "latex", "adhesive_tape",
    "bandage_adhesive", "lidocaine", "novocaine", "local_anesthetics", "general_anesthesia", "propofol", "insulin", "heparin", "warfarin", "shellfish", "shrimp", "crab",
    "lobster", "peanuts", "peanut", "tree_nuts", "almonds", "walnuts", "cashews", "pecans", "eggs", "egg", "milk", "dairy", "lactose", "soy", "soybean", "wheat",
    "gluten", "fish", "salmon", "tuna", "sesame", "pollen", "grass_pollen", "tree_pollen", "ragweed", "dust", "dust_mites", "mold", "mildew", "pet_dander", "cat_dander",
    "dog_dander", "cats", "dogs", "bee_stings", "wasp_stings", "insect_stings", "bee_venom", "nickel", "jewelry",
)
ALLERGEN_ALIASES = {
    "pen": "penicillin", "pcn": "penicillin", "pen vk": "penicillin", "amox": "amoxicillin", "augmentin": "amoxicillin", "sulfa drugs": "sulfa", "sulfur": "sulfa", "bactrim": "sulfamethoxazole", "septra": "sulfamethoxazole", "advil": "ibuprofen", "motrin": "ibuprofen", "aleve": "naproxen", "celebrex": "celecoxib",
    "non-steroidal": "nsaids", "nonsteroidal": "nsaids", "vicodin": "hydrocodone", "norco": "hydrocodone", "percocet": "oxycodone", "oxycontin": "oxycodone", "ultram": "tramadol", "z-pack": "azithromycin", "zithromax": "azithromycin", "zpak": "azithromycin", "cipro": "ciprofloxacin", "levaquin": "levofloxacin",
    "keflex": "cephalexin", "rocephin": "ceftriaxone", "flagyl": "metronidazole", "iv contrast": "contrast_dye", "ct contrast": "contrast_dye", "mri contrast": "contrast_dye", "gadolinium": "contrast_dye", "peanut butter": "peanuts", "shellfish allergy": "shellfish", "lactose intolerant": "lactose",
    "lactose intolerance": "lactose", "hay fever": "pollen", "cat": "cat_dander", "cats": "cat_dander", "dog": "dog_dander", "dogs": "dog_dander", "bee sting": "bee_stings", "bees": "bee_stings", "wasp": "wasp_stings", "wasps": "wasp_stings",
}

# Document cleaning.
BOILERPLATE = (
    "all rights reserved", "isbn", "writing committee", "acknowledgments", "acknowledgements", "conflict of interest", "conflicts of interest", "disclosures", "funding", "financial support", "author contributions", "authors' contributions", "correspondence:", "reprint requests", "reprints:",
    "copyright ©", "copyright (c)", "published by", "doi:", "e-mail:", "email:", "fax:", "tel:", "address:", "received:", "accepted:", "revised:", "online publication", "epub ahead", "supplementary material", "supplemental material", "appendix", "abbreviations:", "keywords:", "key words:",
)
SKIPPED_HEADINGS = ("references", "bibliography", "works cited", "acknowledgments", "acknowledgements", "about the authors", "author information", "conflicts of interest", "disclosures", "funding", "abbreviations", "table of contents", "contents", "index", "appendix", "supplementary", "supplemental", "author contributions")
JOURNAL_SIGNS = (r"\d{4}\s*;\s*\d+", r"\d+\s*\(\s*\d+\s*\)\s*:\s*\d+", r"\d+\s*:\s*\d+\s*[-–]\s*\d+", r"[A-Z][a-z]+\s+[A-Z][A-Z]?\s*[,;]", r"et al\.", r"pp?\.\s*\d+")

# What is no fact in an answer.
NOISE_CONCEPTS = ("greeting", "acknowledgment", "confirmation", "response", "question", "answer", "statement", "conversation", "thanks", "thank_you", "okay", "yes", "no", "understanding", "agreement", "compliance")
