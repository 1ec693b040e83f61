"""Word lists, lookup tables and patterns of the rules.

The rules give the same results only with exactly these values.
"""

# Fixed values, messages.

#: Romanised Tamil to an English concept.
TANGLISH = {
    "panam": "money", "pannam": "money", "kaasu": "money", "roobai": "rupees", "vangi": "bank", "kanakku": "account", "account-u": "account",
    "pancard": "pan card", "aadhar": "aadhaar", "aadhaarkaarth": "aadhaar", "paisa": "money", "transfer pannunga": "transfer money",
    "udane": "immediately", "seekiram": "immediately", "ippo": "now", "innaiku": "today", "naalaikku": "tomorrow", "ipovey": "right now",
    "block aagidum": "will be blocked", "block aagum": "will be blocked", "mudangum": "will be frozen", "mudakkapadum": "will be frozen",
    "nirutthapadum": "will be suspended", "ratthu": "cancelled", "kaalavadhi": "expired", "mudiyum": "will expire", "avasaram": "urgent",
    "avasara": "urgent", "eccharikkai": "warning", "click pannunga": "click", "click pannu": "click", "click seiyavum": "click",
    "அழுத்துங்கள்": "click", "share pannunga": "share", "anuppunga": "send", "anuppavum": "send", "sollunga": "tell", "update pannunga": "update",
    "seiyavum": "do", "pannunga": "do", "potta": "put", "varum": "will come", "kuduthidunga": "give", "kodunga": "give", "thaa": "give",
    "kekkuranga": "asking", "kadavuchol": "password", "ragasiya": "secret", "ragasiyam": "secret", "otp number": "otp", "pin number": "pin",
    "parisu": "prize", "ilavasam": "free", "ilavasa": "free", "bahumathi": "reward", "vetri": "won", "jeichinga": "won", "jeichittinga": "won",
    "velai": "job", "velaivaaippu": "job opportunity", "sambalam": "salary", "laabam": "profit", "mudhaleedu": "investment",
    "kaavalthurai": "police", "arasu": "government", "adhikari": "officer", "vanganga": "bank", "mintsaram": "electricity",
    "minsaram": "electricity", "karandu": "electricity", "pesaren": "speaking", "pesuren": "speaking", "kattunga": "pay", "kattanum": "must pay",
    "kattavum": "pay", "hold aagirukku": "is on hold", "stuck aagirukku": "is stuck", "return pannidum": "will be returned",
    "sambathikkalam": "can earn", "guarantee": "guaranteed", "velaivaippu": "job opportunity", "deposit pannunga": "deposit",
    "register pannunga": "register", "install pannunga": "install", "approve pannunga": "approve", "verify pannunga": "verify",
    "confirm pannunga": "confirm", "download pannunga": "download", "open pannunga": "open", "aagiduchu": "has happened", "aaiduchu": "has happened",
    "mudinjiduchu": "has expired", "irukku": "is there", "illana": "otherwise", "illaina": "otherwise", "vaadikkaiyalar": "customer",
    "vaadikaiyaalare": "customer", "anbudan": "dear", "iniya": "dear", "nandri": "thanks", "ungal": "your", "unga": "your", "neengal": "you",
    "neenga": "you",
}

#: Tamil to an English concept.
TAMIL = {
    "உடனே": "immediately", "அவசரம்": "urgent", "இன்று": "today", "முடக்கப்படும்": "will be frozen", "நிறுத்தப்படும்": "will be suspended",
    "கணக்கு": "account", "வங்கி": "bank", "பணம்": "money", "ரூபாய்": "rupees", "கடவுச்சொல்": "password", "ரகசிய": "secret", "பரிசு": "prize",
    "இலவச": "free", "வேலை": "job", "முதலீடு": "investment", "காவல்துறை": "police", "அரசு": "government", "மின்சாரம்": "electricity",
    "சரிபார்": "verify", "புதுப்பி": "update", "அழுத்த": "click", "கிளிக்": "click", "இணைப்பு": "connection link", "காலாவதி": "expired",
    "வாடிக்கையாளர்": "customer", "ஆதார்": "aadhaar", "பான்": "pan card", "உறுதியான": "guaranteed", "உறுதி": "guaranteed", "லாபம்": "profit",
    "செய்து": "do", "பெறுங்கள்": "receive", "மாதம்": "month", "தினமும்": "daily", "விவரங்கள்": "details", "விவரங்களுக்கு": "for details",
    "தொடர்பு": "contact", "அழைக்கவும்": "call", "அனுப்பவும்": "send", "அனுப்பு": "send", "செலுத்தவும்": "pay", "செலுத்த": "pay",
    "கட்டணம்": "fee payment", "திரும்பப்": "refund", "திரும்ப": "refund", "பரிவர்த்தனை": "transaction", "தோல்வியுற்ற": "failed",
    "கோரிக்கை": "request", "கோரிக்கையை": "request", "ஏற்கவும்": "approve", "அறிவிப்பு": "notice", "அரசு அறிவிப்பு": "government notice",
    "நீதிமன்ற": "court", "நோட்டீஸ்": "notice", "அதிகாரி": "officer", "தவறாக": "wrongly", "பயன்படுத்தப்பட்டுள்ளது": "has been misused",
    "சுங்கம்": "customs", "சுங்கத்தில்": "customs", "பொருள்": "parcel", "நிறுத்தப்பட்டுள்ளது": "is held", "துண்டிக்கப்படும்": "will be disconnected",
    "சேவை": "service", "சேவைக்காக": "for service", "செயலி": "app", "செயலியை": "app", "நிறுவி": "install", "நிறுவ": "install", "அனுமதி": "permission",
    "வழங்கவும்": "grant", "பதிவு": "register", "பதிவு செய்யவும்": "register", "சரிபார்க்கவும்": "verify", "சரிபார்க்கப்படவில்லை": "not verified",
    "புதுப்பிக்கவும்": "update", "இணைக்கவும்": "link", "அழுத்துங்கள்": "click", "அழுத்தவும்": "click", "பூட்டப்பட்டுள்ளது": "is locked",
    "மீண்டும் திறக்க": "to unlock", "சந்தேகத்திற்குரிய": "suspicious", "நுழைவு": "login", "பாதுகாப்பு": "security", "எச்சரிக்கை": "warning",
    "வென்றுள்ளீர்கள்": "you have won", "வென்றீர்கள்": "you have won", "வாழ்த்துக்கள்": "congratulations", "அதிர்ஷ்ட": "lucky",
    "குலுக்கல்": "lucky draw", "குலுக்கலில்": "lucky draw", "சம்பாதிக்கலாம்": "can earn", "வீட்டிலிருந்தே": "work from home", "சம்பளம்": "salary",
    "வழக்கு": "case", "பதிவாகியுள்ளது": "has been registered", "கைது": "arrest", "அபராதம்": "penalty", "முடிந்துவிட்டது": "has expired",
    "இரவு": "tonight", "மணி": "hours", "நேரம்": "time", "மட்டுமே": "only", "இல்லையெனில்": "otherwise", "உடனடியாக": "immediately",
    "மின்சார": "electricity", "மின்": "electricity", "நன்றி": "thanks", "கணக்கில்": "in account",
}

#: Words that mark a text as English.
ENGLISH_STOPWORDS = [
    "a", "account", "amount", "and", "are", "bank", "be", "been", "blocked", "by", "card", "click", "complete", "customer", "dear", "details", "do",
    "expired", "for", "from", "has", "have", "hours", "if", "immediately", "in", "is", "it", "link", "madam", "not", "now", "number", "of", "on",
    "our", "payment", "please", "received", "sir", "that", "the", "this", "to", "today", "update", "urgent", "us", "verify", "we", "will", "with",
    "within", "you", "your",
]

#: Places.
LOCALITIES = [
    "adyar", "velachery", "thoraipakkam", "sholinganallur", "perungudi", "pallikaranai", "medavakkam", "madipakkam", "guindy", "saidapet",
    "besant nagar", "thiruvanmiyur", "kotturpuram", "alwarpet", "mylapore", "tambaram", "chromepet", "pallavaram", "navalur", "siruseri", "omr",
    "ecr", "porur", "taramani", "neelankarai", "injambakkam", "karapakkam", "chennai", "tamil nadu", "tamilnadu", "coimbatore", "madurai", "trichy",
]

#: Suffixes of payment handles.
UPI_SUFFIXES = [
    "upi", "ybl", "ibl", "axl", "apl", "paytm", "okaxis", "oksbi", "okhdfcbank", "okicici", "okbizaxis", "airtel", "freecharge", "jio", "hdfcbank",
    "icici", "sbi", "axisbank", "yesbank", "kotak", "fbl", "barodampay", "cnrb", "idfcbank", "indus", "pingpay", "postbank", "rmhdfc", "timecosmos",
    "waaxis", "wahdfcbank", "waicici", "wasbi", "abfspay", "slc", "dbs", "federal", "myicici", "aubank",
]

#: Brands named in messages: name, official domains, other spellings.
BRANDS = {
    "sbi": {
        "display": "State Bank of India",
        "domains": ["sbi.co.in", "onlinesbi.sbi", "onlinesbi.com", "sbiyono.sbi"],
        "aliases": ["state bank", "yono", "sbi bank", "onlinesbi"],
    },
    "hdfc": {"display": "HDFC Bank", "domains": ["hdfcbank.com", "hdfc.com"], "aliases": ["hdfc bank"]},
    "icici": {"display": "ICICI Bank", "domains": ["icicibank.com"], "aliases": ["icici bank", "imobile"]},
    "axis": {"display": "Axis Bank", "domains": ["axisbank.com"], "aliases": ["axis bank"]},
    "kotak": {"display": "Kotak Mahindra Bank", "domains": ["kotak.com"], "aliases": ["kotak bank"]},
    "indianbank": {"display": "Indian Bank", "domains": ["indianbank.in", "indianbank.net.in"], "aliases": ["indian bank"]},
    "iob": {"display": "Indian Overseas Bank", "domains": ["iob.in"], "aliases": ["indian overseas bank"]},
    "canara": {"display": "Canara Bank", "domains": ["canarabank.com"], "aliases": ["canara bank"]},
    "rbi": {"display": "Reserve Bank of India", "domains": ["rbi.org.in"], "aliases": ["reserve bank"]},
    "paytm": {"display": "Paytm", "domains": ["paytm.com", "paytmbank.com"], "aliases": []},
    "phonepe": {"display": "PhonePe", "domains": ["phonepe.com"], "aliases": ["phone pe"]},
    "gpay": {"display": "Google Pay", "domains": ["pay.google.com", "google.com"], "aliases": ["google pay", "g pay"]},
    "upi": {"display": "UPI / NPCI", "domains": ["npci.org.in"], "aliases": ["npci", "bhim"]},
    "amazon": {"display": "Amazon", "domains": ["amazon.in", "amazon.com"], "aliases": []},
    "flipkart": {"display": "Flipkart", "domains": ["flipkart.com"], "aliases": []},
    "tneb": {"display": "TNEB / TANGEDCO", "domains": ["tnebnet.org", "tangedco.gov.in"], "aliases": ["tangedco", "eb bill", "electricity board"]},
    "incometax": {"display": "Income Tax Department", "domains": ["incometax.gov.in"], "aliases": ["income tax", "it department", "itr"]},
    "epfo": {"display": "EPFO", "domains": ["epfindia.gov.in"], "aliases": ["pf office", "provident fund"]},
    "aadhaar": {"display": "UIDAI / Aadhaar", "domains": ["uidai.gov.in"], "aliases": ["uidai"]},
    "irctc": {"display": "IRCTC", "domains": ["irctc.co.in"], "aliases": []},
    "bluedart": {"display": "Blue Dart", "domains": ["bluedart.com"], "aliases": ["blue dart"]},
    "indiapost": {"display": "India Post", "domains": ["indiapost.gov.in"], "aliases": ["india post", "speed post"]},
    "dhl": {"display": "DHL", "domains": ["dhl.com"], "aliases": []},
    "fedex": {"display": "FedEx", "domains": ["fedex.com"], "aliases": []},
    "whatsapp": {"display": "WhatsApp", "domains": ["whatsapp.com", "wa.me"], "aliases": []},
    "netflix": {"display": "Netflix", "domains": ["netflix.com"], "aliases": []},
    "jio": {"display": "Reliance Jio", "domains": ["jio.com"], "aliases": []},
    "airtel": {"display": "Airtel", "domains": ["airtel.in"], "aliases": []},
}

#: Order of entity types.
ENTITY_TYPES = [
    "phone", "url", "domain", "email", "upi", "handle", "brand", "locality", "date", "amount", "txn_id", "ifsc", "sender_id",
]

#: Patterns of the intent families.
INTENTS = {
    "urgency": [
        r"\bimmediately\b", r"\burgent(ly)?\b", r"\bright now\b", r"\bwithin \d+\s?(hours?|hrs?|minutes?|mins?|days?)\b",
        r"\bbefore (today|tonight|midnight|\d)", r"\blast (reminder|chance|warning)\b", r"\bexpir(e|es|ed|ing|y)\b", r"\bact (now|fast|today)\b",
        r"\btoday itself\b", r"\bonly \d+ (hours?|minutes?) left\b", r"\bfinal notice\b", r"\bdo it now\b", r"\bbefore it expires\b",
        r"\bexpires? (today|tonight|soon)\b", r"\btoday only\b", r"\b(at|by) \d{1,2}(:\d{2})? ?(am|pm)\b", r"\bimmediate(ly)? action\b",
        r"\bpending\b", r"\bhurry\b", r"\bquickly\b", r"\bseekiram\b", r"\budane\b", r"\bavasaram\b", r"\binnaiku\b", r"\bippo\b", r"\bnow\b",
    ],
    "threat": [
        r"\bwill be (blocked|suspended|frozen|closed|deactivated|terminated|disconnected)\b",
        r"\b(account|card|sim|connection|service) (block|suspend|freeze|closure)\w*\b", r"\blegal action\b", r"\bfir\b", r"\barrest(ed)?\b",
        r"\bpenalty\b", r"\bfine of\b", r"\bcourt (notice|summons)\b", r"\bcyber cell\b", r"\bnon[- ]bailable\b", r"\bdigital arrest\b",
        r"\bcase (has been )?(filed|registered)\b",
    ],
    "credential_request": [
        r"\botp\b", r"\bone[- ]time password\b", r"\bcvv\b", r"\bpin\b", r"\bpassword\b", r"\bmpin\b", r"\bupi pin\b",
        r"\bnet ?banking (id|login|credentials)\b", r"\buser ?id and password\b", r"\bshare (your )?(otp|pin|cvv|password)\b",
        r"\blogin (here|now|to verify)\b", r"\benter your (card|account|aadhaar|pan)\b", r"\bverify (your )?(account|identity|kyc|details)\b",
        r"\bre[- ]?kyc\b", r"\bshare (your )?(account|bank|card) details\b", r"\bsubmit (your )?bank details\b",
        r"\bbank details (kuduthidunga|anuppunga|share)\b", r"\bconfirm your (credentials|details)\b",
        r"\bshare (the )?(otp|code|id) (received|with)\b", r"\baccount details\b", r"\bupdate (your )?(kyc|pan|aadhaar|details)\b",
        r"\blink (your )?(pan|aadhaar)\b", r"\bsecure your account\b", r"\brestore access\b", r"\bto unlock\b", r"\bconfirm your identity\b",
        r"\breactivate\b",
    ],
    "payment_request": [
        r"\bpay (rs|inr|₹|now|immediately)\b", r"\btransfer (rs|inr|₹|the amount|money)\b", r"\bsend (rs|inr|₹|money|payment)\b", r"\bupi\b",
        r"\bscan (the )?qr\b", r"\bprocessing fee\b", r"\bsecurity deposit\b", r"\bregistration (fee|charge)\b", r"\bgst (charge|fee|payment)\b",
        r"\bcustoms (duty|clearance|fee)\b", r"\brefundable (amount|deposit)\b", r"\bcollect request\b", r"\bapprove the request\b",
        r"\b(duty|fee|charge|penalty|bill|amount) (kattunga|kattanum|settle|pay)\b", r"\bsettle (now|the|your)\b", r"\bpay(ment)? (of )?rs\b",
        r"\bhandling fee\b", r"\bshipping charge\b", r"\bdelivery charge\b", r"\bdeposit\b", r"\b(anuppunga|anuppavum|kattunga|kattanum)\b",
        r"\bprocessing charge\b", r"\bpay .{0,20}(immediately|now|today|here)\b", r"\bmudhaleedu\b", r"\bfee payment\b", r"\bcustoms\b",
        r"\bpay\b.{0,18}\b(fee|duty|charge|customs|penalty|bill|amount)\b", r"\bapprove\b.{0,12}\brequest\b", r"\brequest approve\b",
    ],
    "reward_bait": [
        r"\bcongratulations?\b", r"\byou (have )?(won|win)\b", r"\blucky (draw|winner)\b", r"\blottery\b", r"\bprize\b", r"\bcashback\b",
        r"\bbonus\b", r"\bgift (card|voucher|hamper)\b", r"\bfree (recharge|gift|iphone|offer)\b", r"\breward points? (expir|redeem)\w*\b",
        r"\bclaim (your|now|the)\b", r"\bguaranteed (return|profit|income)\b", r"\bdaily (income|earning)\b", r"\bwork from home\b",
        r"\bpart[- ]time job\b", r"\bearn (rs|inr|₹|upto|up to)\b", r"\bdouble your (money|investment)\b", r"\bdaily (profit|payout)\b",
        r"\bweekly (salary|payout|income)\b", r"\bguarantee[d]?\b", r"\bno experience (needed|required)\b", r"\brefundable\b",
        r"\boverchar(ge|ged)\b", r"\bshortlisted\b", r"\bselected for (you|your)\b", r"\bjackpot\b", r"\bparisu\b", r"\bjeichit?t?inga\b",
        r"\bsambathikkalam\b", r"\bsampaathi\b", r"\b\d{2,3}% return\b", r"\bprofit\b",
    ],
    "authority_impersonation": [
        r"\brbi\b", r"\breserve bank\b", r"\bincome tax (department|dept)\b", r"\bcyber (crime|cell|police)\b", r"\bpolice\b", r"\bcbi\b",
        r"\bed\b(?= officer)", r"\btrai\b", r"\bcourier (company|department)\b", r"\bcustoms\b", r"\bnarcotics\b",
        r"\b(bank|government|govt) official\b", r"\bexecutive (calling|from)\b", r"\bhelpline\b", r"\bcustomer (care|support) (number|team)\b",
        r"\bofficer\b", r"\bcompliance department\b", r"\b(tangedco|tneb|electricity board)\b", r"\buidai\b", r"\bnpci\b",
        r"\bgovernment (notice|alert)\b", r"\bbank (support|executive) (here|speaking)\b", r"\bour (technician|executive)\b", r"\bpesaren\b",
        r"\bkaavalthurai\b", r"\bofficer speaking\b", r"\bgovernment notice\b", r"\bcourt notice\b", r"\bnotice\b(?= .{0,20}officer)",
    ],
    "remote_access": [
        r"\banydesk\b", r"\bteam ?viewer\b", r"\bquick ?support\b", r"\bairdroid\b", r"\bscreen (share|sharing)\b", r"\binstall (this|the) app\b",
        r"\bdownload (the )?apk\b", r"\b\.apk\b", r"\ballow access\b", r"\ballow all permissions\b", r"\bconnection id\b", r"\b9 digit code\b",
        r"\bscreen access\b", r"\bsupport app\b", r"\binstall .{0,24}(app|application|apk)\b",
    ],
    "contact_pivot": [
        r"\bwhatsapp (me|us|on|number)\b", r"\bcall (me|us|this number|immediately) (on|at)?\b", r"\bcontact (us|our) (executive|officer|team)\b",
        r"\breply (yes|stop|with)\b", r"\bdo not (tell|inform|discuss)\b", r"\bkeep (this )?confidential\b", r"\btelegram (group|channel)\b",
        r"\bjoin (our|the) group\b", r"\bdo not share this (link|message) with (others|anyone)\b", r"\bpress \d\b",
        r"\bcall (this |the )?(number|officer|executive)\b", r"\bcall \+?\d", r"\bcontact \+?\d", r"\bwhatsapp \+?\d",
    ],
}

#: Scam classes: label, related families, patterns.
SCAM_CLASSES = {
    "kyc_account_freeze": {
        "label": "KYC / Account-freeze scam",
        "patterns": [r"\bkyc\b", r"\bre[- ]?kyc\b", r"\bpan (card )?(link|update|verif)", r"\baadhaar (link|update|verif)", r"\baccount will be (blocked|frozen|suspended)", r"\bupdate your (kyc|details) to avoid", r"\byono (app|account)", r"\bnet ?banking (block|suspend)"],
        "intents": ["threat", "urgency", "credential_request"],
    },
    "phishing_link": {
        "label": "Phishing link",
        "patterns": [r"\bclick (here|this|the link|below)", r"\blogin (here|now)", r"\bverify (here|now|your account)", r"\bsecure(d)? link", r"\bupdate (here|now)", r"\bactivate (here|now)"],
        "intents": ["credential_request", "urgency"],
    },
    "impersonation": {
        "label": "Authority / brand impersonation",
        "patterns": [r"\brbi\b", r"\bcyber (crime|cell)", r"\bpolice\b", r"\bincome tax\b", r"\bcustoms\b", r"\bdigital arrest\b", r"\bcourt (notice|summons)", r"\bofficer speaking\b", r"\btrai\b", r"\bcbi\b", r"\bnarcotics\b", r"\bwarrant\b", r"\bcompliance department\b", r"\bcustoms officer\b", r"\bpesaren\b", r"\bkaavalthurai\b", r"\bgovernment notice\b", r"\bcourt\b", r"\bmisused\b"],
        "intents": ["authority_impersonation", "threat"],
    },
    "refund_cashback": {
        "label": "Refund / cashback scam",
        "patterns": [r"\brefund\b", r"\bcashback\b", r"\breversal\b", r"\bwrongly (debited|charged)", r"\bclaim your refund\b", r"\bitr refund\b", r"\bincome tax refund\b", r"\bfailed transaction\b", r"\boverchar(ge|ged)\b", r"\brefundable\b", r"\breversal process\b", r"\bcollect request\b", r"\bapprove\b.{0,12}\brequest\b", r"\brefund\b"],
        "intents": ["payment_request", "reward_bait"],
    },
    "job_investment": {
        "label": "Job / investment scam",
        "patterns": [r"\bwork from home\b", r"\bpart[- ]time job\b", r"\bdaily (income|earning|payout)", r"\btask (based|complete)", r"\btelegram (group|channel)", r"\bguaranteed (return|profit)", r"\btrading (account|signal|group)", r"\bcrypto (profit|doubling)", r"\binvest (rs|₹|now)", r"\bearn (rs|₹)\s?\d", r"\bno experience\b", r"\bdata entry\b", r"\bhiring\b", r"\bdaily profit\b", r"\bweekly salary\b", r"\bvelai\b", r"\b\d{2,3}% return\b", r"\bmudhaleedu\b", r"\binvestment\b", r"\bcan earn\b", r"\bguaranteed\b", r"\bprofit\b", r"\bmonthly (income|return)\b"],
        "intents": ["reward_bait", "payment_request"],
    },
    "lottery_prize": {
        "label": "Lottery / prize scam",
        "patterns": [r"\blottery\b", r"\blucky (draw|winner)", r"\byou (have )?won\b", r"\bprize money\b", r"\bkbc\b", r"\bjackpot\b", r"\bgift (hamper|voucher) (won|selected)", r"\bshortlisted\b", r"\blucky winner\b", r"\bfree iphone\b", r"\bparisu\b", r"\bjeichit?t?inga\b", r"\bprize\b"],
        "intents": ["reward_bait", "payment_request"],
    },
    "delivery_scam": {
        "label": "Delivery / courier scam",
        "patterns": [r"\b(parcel|package|shipment|consignment)\b", r"\bdelivery (failed|attempt|address)", r"\bcourier (held|stuck|pending)", r"\bcustoms (duty|clearance)", r"\btracking (id|number)", r"\baddress (incomplete|incorrect)", r"\breschedule (your )?delivery", r"\bredelivery\b", r"\bhandling fee\b", r"\bshipping charge\b", r"\breturn to sender\b", r"\bconsignment held\b", r"\bcustoms\b", r"\bis held\b", r"\bfee payment\b"],
        "intents": ["payment_request", "urgency"],
    },
    "remote_access_scam": {
        "label": "Remote-access / malicious app scam",
        "patterns": [r"\banydesk\b", r"\bteam ?viewer\b", r"\b\.apk\b", r"\binstall (this|our) app", r"\bscreen shar", r"\bdownload (the )?application", r"\bquicksupport\b", r"\bconnection id\b", r"\ballow all permissions\b", r"\bscreen access\b"],
        "intents": ["remote_access"],
    },
    "utility_bill": {
        "label": "Utility / electricity-bill scam",
        "patterns": [r"\belectricity\b", r"\bpower (will be )?(cut|disconnect)", r"\btneb\b", r"\btangedco\b", r"\bmeter (reading|update)", r"\bbill (not |un)?(paid|pending)", r"\bdisconnect(ed|ion)?\b", r"\bgas (connection|subsidy)", r"\bpower supply\b", r"\bkarandu\b", r"\bminsaram\b", r"\bconsumer\b", r"\bmeter\b"],
        "intents": ["threat", "urgency", "payment_request"],
    },
    "legitimate": {"label": "No scam pattern detected", "patterns": [], "intents": []},
}

#: Patterns of harmless messages.
BENIGN = [
    r"\bdo not share your otp with anyone\b", r"\bbank never asks\b", r"\bnever share your (otp|pin|cvv)\b",
    r"\bthis is an automated (message|notification)\b", r"\bthank you for (shopping|banking|your payment)\b", r"\bavl bal\b",
    r"\bavailable balance\b", r"\byour (order|parcel) .{0,30}\b(has been )?delivered\b", r"\botp for .{0,40} is \d{4,8}\b",
    r"\bcredited to your (a/c|account)\b", r"\bdebited from your (a/c|account)\b",
]

#: Most points of each evidence family.
FAMILY_CAPS = {
    "message_intent": 25.0,
    "url_technical": 25.0,
    "entity_reputation": 20.0,
    "campaign_similarity": 15.0,
    "context_anomaly": 15.0,
}

#: Points of an intent family.
INTENT_WEIGHTS = {
    "credential_request": 10.0,
    "threat": 8.0,
    "payment_request": 7.5,
    "remote_access": 9.0,
    "urgency": 6.0,
    "reward_bait": 6.5,
    "authority_impersonation": 6.5,
    "contact_pivot": 4.0,
}

#: Names of the intent families.
INTENT_LABELS = {
    "urgency": "Artificial time pressure", "threat": "Threat of loss or penalty", "credential_request": "Asks for credentials (OTP/PIN/password)",
    "payment_request": "Asks you to pay or transfer money", "reward_bait": "Too-good-to-be-true reward",
    "authority_impersonation": "Claims to be an authority or official", "remote_access": "Pushes remote-access or sideloaded apps",
    "contact_pivot": "Pushes you to a private channel",
}

#: Phrases of short messages.
SMS_URGENCY_PHRASES = [
    "immediately", "urgent", "tonight", "within 24 hours", "24 hrs", "today", "will be blocked", "will be suspended", "deactivated", "last reminder",
    "action required", "expir", "penalty", "disconnect", "disconnected",
]

#: Phrases of short messages.
SMS_FINANCIAL_LURES = [
    "lottery", "prize", "cashback", "bonus", "reward", "credited", "refund", "earn rs", "work from home", "part time job", "income tax refund",
    "gift card",
]

#: Phrases of short messages.
SMS_KYC_TRAPS = [
    "kyc", "pan card", "aadhaar", "yono", "netbanking", "update kyc", "link pan", "verify account", "unblock", "reactivate", "credit card limit",
]

#: Phrases of short messages.
SMS_UTILITY_TRAPS = [
    "electricity", "power", "meter", "bill unpaid", "disconnection", "officer", "chalan", "traffic fine", "challan", "tneb", "bescom",
]

# Fixed values, URLs.

#: Top-level domains that count as suspicious.
SUSPICIOUS_TLDS = [
    "bid", "buzz", "cam", "cc", "cf", "cfd", "click", "club", "date", "faith", "fun", "ga", "gdn", "gq", "icu", "link", "live", "loan", "ml",
    "monster", "online", "racing", "rest", "review", "site", "space", "stream", "surf", "tk", "top", "win", "work", "xyz", "zip",
]

#: Words that count as suspicious in a URL.
SUSPICIOUS_WORDS = [
    "login", "verify", "verification", "update", "secure", "account", "banking", "kyc", "pan", "aadhaar", "otp", "password", "support", "confirm",
    "signin", "ebank", "netbanking", "wallet", "refund", "claim", "bonus", "reward", "free", "recharge", "suspend", "suspended", "restore",
    "reactivate", "alert", "notice",
]

#: Brand words and their official domains.
LEGACY_BRANDS = {
    "sbi": [
        "onlinesbi.sbi", "sbi.co.in", "sbi.sbi", "bank.sbi", "statebankofindia.com", "sbi.bank.in", "onlinesbi.sbi.bank.in", "retail.sbi.bank.in",
        "corporate.sbi.bank.in", "sbi-card.com", "sbicard.com",
    ],
    "hdfc": ["hdfcbank.com", "hdfc.com", "hdfc.bank.in", "hdfcbank.bank.in", "hdfcbank.net", "hdfcsec.com"],
    "icici": ["icicibank.com", "icici.com", "icici.bank.in", "icicidirect.com"],
    "axis": ["axisbank.com", "axis.bank.in"],
    "pnb": ["pnbindia.in", "pnb.bank.in"],
    "canara": ["canarabank.com", "canara.bank.in"],
    "bankofbaroda": ["bankofbaroda.in", "bankofbaroda.com", "bob.bank.in"],
    "kotak": ["kotak.com", "kotak.bank.in", "kotakcherry.com"],
    "rbi": ["rbi.org.in"],
    "paytm": ["paytm.com", "paytmbank.com", "paytm.bank.in"],
    "phonepe": ["phonepe.com"],
    "gpay": ["google.com", "pay.google.com"],
    "google": ["google.com", "google.co.in", "accounts.google.com", "myaccount.google.com"],
    "apple": ["apple.com", "icloud.com", "appleid.apple.com"],
    "microsoft": ["microsoft.com", "live.com", "office.com", "login.microsoftonline.com"],
    "amazon": ["amazon.in", "amazon.com"],
    "netflix": ["netflix.com"],
    "paypal": ["paypal.com"],
    "tneb": ["tnebltd.gov.in", "tangedco.gov.in", "tnebltd.com"],
    "indiapost": ["indiapost.gov.in", "ippbonline.com", "ippb.bank.in"],
}

#: Registered names under bank.in.
BANK_IN_ROOTS = {
    "sbi": "State Bank of India (SBI)", "hdfc": "HDFC Bank", "hdfcbank": "HDFC Bank", "icici": "ICICI Bank", "axis": "Axis Bank",
    "pnb": "Punjab National Bank", "canara": "Canara Bank", "bob": "Bank of Baroda", "kotak": "Kotak Mahindra Bank",
    "unionbank": "Union Bank of India", "unionbankofindia": "Union Bank of India", "boi": "Bank of India", "indianbank": "Indian Bank",
    "centralbank": "Central Bank of India", "idbi": "IDBI Bank", "yesbank": "Yes Bank", "indusind": "IndusInd Bank", "federalbank": "Federal Bank",
    "rblbank": "RBL Bank", "ippb": "India Post Payments Bank (IPPB)",
}

#: Other spellings of brand words.
LEGACY_ALIASES = {
    "sbi": ["onlinesbi", "statebankofindia", "sbicard", "sbibank", "sbionline"],
    "hdfc": ["hdfcbank", "hdfcsec", "hdfcnetbanking"],
    "icici": ["icicibank", "icicidirect", "icicinetbanking"],
    "axis": ["axisbank", "axisnetbanking"],
    "pnb": ["pnbindia", "pnbnetbanking"],
    "kotak": ["kotakbank", "kotakcherry", "kotaknetbanking"],
    "paypal": ["paypalme"],
    "paytm": ["paytmbank", "paytmmall"],
    "google": ["googlepay", "gpay"],
}

#: Affixes that are cut off before a brand is compared.
BANK_AFFIXES = [
    "online", "netbanking", "ebank", "bank", "banking", "portal", "corp", "corporate", "retail", "secure", "auth", "card", "pay",
]

#: Known bad domains.
THREAT_LIST = {
    "sbi-kyc-update.xyz": {"category": "PHISHING", "source": "ThreatFeed_URLhaus"},
    "hdfc-rewards-claim.top": {"category": "PHISHING", "source": "ThreatFeed_PhishTank"},
    "icici-netbanking-verify.cc": {"category": "PHISHING", "source": "ThreatFeed_OpenPhish"},
    "paytm-cashback-bonus.live": {"category": "PHISHING", "source": "ThreatFeed_URLhaus"},
    "tneb-bill-payment.net": {"category": "PHISHING", "source": "ThreatFeed_Community"},
    "free-netflix-subscription.club": {"category": "PHISHING", "source": "ThreatFeed_PhishTank"},
    "paypal-account-recovery.top": {"category": "PHISHING", "source": "ThreatFeed_URLhaus"},
}

#: Brands compared with hosts.
BRAND_REGISTRY = {
    "amazon": {
        "display_name": "Amazon",
        "official_domains": ["amazon.com", "amazon.in", "amazon.co.uk", "amazon.de", "amazon.ca", "amazon.co.jp"],
        "aliases": ["amzn"],
    },
    "paypal": {"display_name": "PayPal", "official_domains": ["paypal.com", "paypal.me"], "aliases": ["pp"]},
    "sbi": {
        "display_name": "State Bank of India (SBI)",
        "official_domains": ["onlinesbi.sbi", "sbi.co.in", "sbi.sbi", "bank.sbi", "statebankofindia.com", "sbi.bank.in", "onlinesbi.sbi.bank.in", "retail.sbi.bank.in", "corporate.sbi.bank.in", "sbi-card.com", "sbicard.com"],
        "aliases": ["onlinesbi", "sbicard", "statebankofindia"],
    },
    "hdfc": {
        "display_name": "HDFC Bank",
        "official_domains": ["hdfcbank.com", "hdfc.com", "hdfc.bank.in", "hdfcbank.bank.in", "hdfcbank.net", "hdfcsec.com"],
        "aliases": ["hdfcbank", "hdfcsec"],
    },
    "icici": {
        "display_name": "ICICI Bank",
        "official_domains": ["icicibank.com", "icici.com", "icici.bank.in", "icicidirect.com"],
        "aliases": ["icicibank", "icicidirect"],
    },
    "axis": {"display_name": "Axis Bank", "official_domains": ["axisbank.com", "axis.bank.in"], "aliases": ["axisbank"]},
    "pnb": {"display_name": "Punjab National Bank (PNB)", "official_domains": ["pnbindia.in", "pnb.bank.in"], "aliases": ["pnbindia"]},
    "kotak": {
        "display_name": "Kotak Mahindra Bank",
        "official_domains": ["kotak.com", "kotak.bank.in", "kotakcherry.com"],
        "aliases": ["kotakbank", "kotakmahindra"],
    },
    "bankofbaroda": {
        "display_name": "Bank of Baroda",
        "official_domains": ["bankofbaroda.in", "bankofbaroda.com", "bob.bank.in"],
        "aliases": ["bob", "bobcards"],
    },
    "canara": {"display_name": "Canara Bank", "official_domains": ["canarabank.com", "canara.bank.in"], "aliases": ["canarabank"]},
    "paytm": {"display_name": "Paytm", "official_domains": ["paytm.com", "paytmbank.com", "paytm.bank.in"], "aliases": ["paytmbank"]},
    "phonepe": {"display_name": "PhonePe", "official_domains": ["phonepe.com"], "aliases": []},
    "google": {
        "display_name": "Google",
        "official_domains": ["google.com", "google.co.in", "accounts.google.com", "myaccount.google.com", "gmail.com"],
        "aliases": ["gmail", "gpay"],
    },
    "apple": {"display_name": "Apple", "official_domains": ["apple.com", "icloud.com", "appleid.apple.com"], "aliases": ["icloud"]},
    "microsoft": {
        "display_name": "Microsoft",
        "official_domains": ["microsoft.com", "live.com", "office.com", "login.microsoftonline.com", "outlook.com"],
        "aliases": ["office", "outlook", "msn", "onedrive"],
    },
    "netflix": {"display_name": "Netflix", "official_domains": ["netflix.com"], "aliases": []},
    "facebook": {"display_name": "Facebook / Meta", "official_domains": ["facebook.com", "fb.com", "meta.com"], "aliases": ["meta", "fb"]},
    "instagram": {"display_name": "Instagram", "official_domains": ["instagram.com"], "aliases": ["insta", "ig"]},
    "whatsapp": {"display_name": "WhatsApp", "official_domains": ["whatsapp.com", "wa.me"], "aliases": []},
    "telegram": {"display_name": "Telegram", "official_domains": ["telegram.org", "t.me"], "aliases": []},
    "flipkart": {"display_name": "Flipkart", "official_domains": ["flipkart.com"], "aliases": []},
    "ebay": {"display_name": "eBay", "official_domains": ["ebay.com", "ebay.in"], "aliases": []},
    "rbi": {"display_name": "Reserve Bank of India (RBI)", "official_domains": ["rbi.org.in"], "aliases": []},
    "indiapost": {"display_name": "India Post", "official_domains": ["indiapost.gov.in", "ippbonline.com", "ippb.bank.in"], "aliases": ["ippb"]},
}

#: Tokens that lend a host false trust.
DECEPTIVE_TOKENS = [
    "aadhaar", "access", "account", "alert", "app", "auth", "authenticate", "banking", "billing", "care", "center", "centre", "client", "confirm",
    "confirmation", "customer", "direct", "ebank", "help", "helpdesk", "invoice", "kyc", "log-in", "login", "manage", "management", "mobile",
    "netbanking", "notice", "official", "online", "otp", "pan", "password", "pay", "payment", "portal", "reactivate", "recover", "recovery",
    "restore", "secure", "security", "service", "sign-in", "signin", "support", "suspend", "suspended", "unlock", "update", "verification", "verify",
    "wallet", "web",
]

#: Characters that stand for letters.
LEET = {
    "0": "o", "1": "l", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
}

#: Letter groups that look like another letter.
LOOKALIKES = [
    ("rn", "m", "'rn' -> 'm'"), ("vv", "w", "'vv' -> 'w'"), ("cl", "d", "'cl' -> 'd'"), ("nn", "m", "'nn' -> 'm'"),
]

#: Keyword groups and their spellings.
SEMANTIC_GROUPS = {
    "login": ["login", "signin", "log-in", "sign-in"],
    "verify": ["verify", "verification", "verified"],
    "secure": ["secure", "security", "secured"],
    "account": ["account", "accounts"],
    "update": ["update", "updates", "updated"],
    "kyc": ["kyc"],
    "wallet": ["wallet", "wallets"],
    "payment": ["payment", "payments", "pay"],
    "refund": ["refund", "refunds"],
    "bonus": ["bonus", "bonuses"],
    "claim": ["claim", "claims", "claimed"],
    "support": ["support", "supports", "helpdesk"],
}

#: Default ports.
DEFAULT_PORTS = {
    "http": 80,
    "https": 443,
    "ftp": 21,
    "ws": 80,
    "wss": 443,
}

#: Query parameters that only track.
TRACKING_PARAMS = [
    "_hsenc", "_hsmi", "dclid", "fbclid", "feature", "gclid", "gclsrc", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src", "ref_url",
    "source", "twclid", "utm_campaign", "utm_content", "utm_creative_format", "utm_id", "utm_marketing_tactic", "utm_medium", "utm_source",
    "utm_source_platform", "utm_term", "wickedid", "yclid",
]

#: Second levels under two-letter country domains.
SECOND_LEVELS = [
    "ac", "ad", "art", "asn", "bank", "bel", "co", "com", "edu", "firm", "geek", "gen", "go", "gov", "govt", "gr", "id", "idv", "ind", "iwi", "lg",
    "ltd", "me", "mil", "ne", "net", "nic", "or", "org", "per", "plc", "pol", "police", "pp", "res", "sch",
]

#: Suffixes of several labels.
MULTI_PART_TLDS = [
    "ac.in", "ac.jp", "ac.nz", "ac.uk", "ac.za", "ad.jp", "art.br", "asn.au", "bank.in", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.ar",
    "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ph", "com.sg", "com.tr", "com.tw", "ed.jp", "edu.ar", "edu.au",
    "edu.br", "edu.cn", "edu.co", "edu.hk", "edu.in", "edu.mx", "edu.my", "edu.nz", "edu.ph", "edu.sg", "edu.tr", "edu.tw", "firm.in", "gc.ca",
    "geek.nz", "gen.in", "go.jp", "gov.ar", "gov.au", "gov.br", "gov.cn", "gov.co", "gov.hk", "gov.in", "gov.mx", "gov.my", "gov.ph", "gov.sg",
    "gov.tr", "gov.tw", "gov.uk", "gov.za", "govt.nz", "gr.jp", "id.au", "idv.hk", "ind.in", "iwi.nz", "lg.jp", "ltd.uk", "me.uk", "mil.br",
    "mil.in", "ne.jp", "net.au", "net.br", "net.hk", "net.in", "net.nz", "net.sg", "net.uk", "net.za", "nic.in", "or.jp", "org.ar", "org.au",
    "org.br", "org.cn", "org.co", "org.hk", "org.in", "org.mx", "org.my", "org.nz", "org.ph", "org.sg", "org.tr", "org.tw", "org.uk", "org.za",
    "per.sg", "plc.uk", "police.uk", "res.in", "sch.uk",
]

#: Characters that look like a Latin letter: the letter, the script.
CONFUSABLES = {
    "а": ["a", "Cyrillic"],
    "с": ["c", "Cyrillic"],
    "е": ["e", "Cyrillic"],
    "і": ["i", "Cyrillic"],
    "ј": ["j", "Cyrillic"],
    "о": ["o", "Cyrillic"],
    "р": ["p", "Cyrillic"],
    "х": ["x", "Cyrillic"],
    "у": ["y", "Cyrillic"],
    "ѕ": ["s", "Cyrillic"],
    "ԁ": ["d", "Cyrillic"],
    "ԛ": ["q", "Cyrillic"],
    "ԝ": ["w", "Cyrillic"],
    "А": ["A", "Cyrillic"],
    "В": ["B", "Cyrillic"],
    "С": ["C", "Cyrillic"],
    "Е": ["E", "Cyrillic"],
    "Н": ["H", "Cyrillic"],
    "І": ["I", "Cyrillic"],
    "Ј": ["J", "Cyrillic"],
    "К": ["K", "Cyrillic"],
    "М": ["M", "Cyrillic"],
    "О": ["O", "Cyrillic"],
    "Р": ["P", "Cyrillic"],
    "Т": ["T", "Cyrillic"],
    "Х": ["X", "Cyrillic"],
    "У": ["Y", "Cyrillic"],
    "Ѕ": ["S", "Cyrillic"],
    "α": ["a", "Greek"],
    "ο": ["o", "Greek"],
    "ν": ["v", "Greek"],
    "ρ": ["p", "Greek"],
    "τ": ["t", "Greek"],
    "υ": ["u", "Greek"],
    "ι": ["i", "Greek"],
    "κ": ["k", "Greek"],
    "χ": ["x", "Greek"],
    "Α": ["A", "Greek"],
    "Β": ["B", "Greek"],
    "Ε": ["E", "Greek"],
    "Ζ": ["Z", "Greek"],
    "Η": ["H", "Greek"],
    "Ι": ["I", "Greek"],
    "Κ": ["K", "Greek"],
    "Μ": ["M", "Greek"],
    "Ν": ["N", "Greek"],
    "Ο": ["O", "Greek"],
    "Ρ": ["P", "Greek"],
    "Τ": ["T", "Greek"],
    "Χ": ["X", "Greek"],
    "Υ": ["Y", "Greek"],
}

#: Domains of link shorteners.
SHORTENERS = [
    "amzn.to", "bc.vc", "bit.do", "bit.ly", "bl.ink", "buff.ly", "clck.ru", "cur.lv", "cutt.ly", "dub.sh", "fb.me", "git.io", "goo.gl", "ift.tt",
    "is.gd", "linktr.ee", "lnkd.in", "ow.ly", "po.st", "prettylink.com", "qr.ae", "qr.net", "rb.gy", "rebrand.ly", "rotf.lol", "s.id", "short.io",
    "shorte.st", "shorturl.at", "snip.ly", "soo.gd", "t.co", "t.ly", "tiny.cc", "tiny.one", "tinyurl.com", "trib.al", "u.to", "v.gd", "wp.me",
]

#: Address prefixes: number, organisation, country.
ASN_PREFIXES = {
    "8.8.8.8": ["AS15169", "Google LLC", "US"],
    "8.8.4.4": ["AS15169", "Google LLC", "US"],
    "1.1.1.1": ["AS13335", "Cloudflare, Inc.", "US"],
    "1.0.0.1": ["AS13335", "Cloudflare, Inc.", "US"],
    "142.250": ["AS15169", "Google LLC", "US"],
    "172.217": ["AS15169", "Google LLC", "US"],
    "104.16": ["AS13335", "Cloudflare, Inc.", "US"],
    "104.17": ["AS13335", "Cloudflare, Inc.", "US"],
}

