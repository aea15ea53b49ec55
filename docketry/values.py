"""Word lists, lookup tables, constants and patterns of the domain.

They are part of the results (a different list gives different answers), so they
stand here together, in their natural order, as plain text.
"""

# ---- routes and case types -------------------------------------------------
SCHEMA_VERSION = "1.1"
ROUTES = ["money_laundering", "waste", "air_pollution", "building", "noise", "general"]
DEFAULT_ROUTE = "general"
LABEL_TO_ROUTE = {
    "洗錢防制法": "money_laundering",
    "廢棄物清理法": "waste",
    "空氣污染防制法": "air_pollution",
    "建築法": "building",
    "噪音管制法": "noise",
    "其他": "general",
}
CASE_TYPE_ALIASES = {
    "空氣汙染防制法": "空氣污染防制法",
    "空氣汙染管制法": "空氣污染防制法",
    "空氣污染管制法": "空氣污染防制法",
}
CASE_TYPE_TO_ROUTE = {
    "違反洗錢防制法事件": "money_laundering",
    "違反廢棄物清理法事件": "waste",
    "空氣污染防制法事件": "air_pollution",
    "違反建築法事件": "building",
    "違反噪音管制法事件": "noise",
}
CATEGORY_TO_ROUTE = {1: "air_pollution", 2: "money_laundering", 3: "waste"}
CATEGORY_LABEL = {1: "空氣污染防制法", 2: "洗錢防制法", 3: "廢棄物清理法"}
CATEGORY_OTHER = 4
CATEGORY_NONE = 0
CATEGORY_TEXT = {
    0: "不受理(不分類)",
    1: "空氣污染防制法",
    2: "洗錢防制法",
    3: "廢棄物清理法",
    4: "其餘案件",
}
MODEL_CATEGORY_TO_CODE = {"空氣污染防制法": 1, "洗錢防制法": 2, "廢棄物清理法": 3, "其餘案件": 4}

# ---- keyword classification ------------------------------------------------
OTHER_LABEL = "其他"
CASE_TYPE_KEYWORDS = {
    "廢棄物清理法": ["廢棄物清理法", "廢棄物", "棄置", "菸蒂", "清除處理", "環稽字"],
    "建築法": ["建築法", "違章建築", "違規使用", "公安申報", "使用執照", "建管"],
    "噪音管制法": ["噪音管制法", "噪音", "音量", "分貝", "陳情噪音"],
    "空氣污染防制法": ["空氣污染防制法", "空氣污染", "空污", "固定污染源", "排放標準", "粒狀污染物"],
    "洗錢防制法": ["洗錢防制法", "洗錢", "人頭帳戶", "交付帳戶", "書面告誡", "警示帳戶"],
}
CASE_TYPE_NAME_BONUS = 3
CONFIDENCE_DIVISOR = 5.0
CONFIDENCE_THRESHOLD = 0.5
CATEGORY_KEYWORDS = {
    1: ["空氣污染防制法", "空氣污染物排放", "固定污染源", "排放標準", "新北環空字"],
    2: ["洗錢防制法", "書面告誡", "帳戶", "警刑字"],
    3: ["廢棄物清理法", "廢棄物", "菸蒂", "棄置", "環稽字"],
}
CATEGORY_NAME_BONUS = 5
CATEGORY_NO_HIT = "未命中三類法規關鍵詞,歸為其餘案件"

# ---- document types --------------------------------------------------------
FOLDER_TO_DOC_TYPE = {
    "歷史訴願決定書": "decision",
    "相關法規": "law",
    "行政函釋": "interpretation",
    "司法院釋字及行政判解": "judgment",
}
SUBFOLDER_TO_DOC_TYPE = {
    "statutes": "law",
    "interpretations": "interpretation",
    "judicial": "judgment",
}
COMMON_LAWS = [
    "訴願法", "行政程序法", "行政罰法", "行政執行法", "行政訴訟法", "民法",
    "中華民國憲法", "中華民國刑法", "中央法規標準法", "個人資料保護法",
    "行政院及各級行政機關訴願審議委員會審議規則", "訴願扣除在途期間辦法",
]
SOURCE_LAW_LIMIT = 30
METADATA_BYTE_LIMIT = 1024
STEM_LIMIT = 120

# ---- sections of a decision ------------------------------------------------
MAIN_MARKERS = ["主文", "主 文"]
REASON_MARKERS = ["事實及理由", "事實與理由", "理由", "事實"]
LAW_BASIS_MARKERS = ["按", "查"]
APPLICATION_MARKERS = ["卷查", "經查", "惟查", "揆諸"]
CONCLUSION_MARKERS = ["綜上論結", "綜上所述", "綜上"]

# ---- personal data ---------------------------------------------------------
MASK = "○○○"
ID_PATTERN = r"(?<![A-Z0-9])[A-Z][12]\d{8}(?![0-9])"
ADDRESS_PATTERN = (
    r"[一-鿿]{2,4}[縣市][一-鿿]{1,4}?[區鄉鎮市]"
    r"[一-鿿0-9０-９]{0,20}?(?:路|街|大道)"
    r"[一-鿿0-9０-９之\-]{0,24}?號"
    r"(?:之\s*\d+)?(?:\s*\d+\s*樓)?(?:\s*之\s*\d+)?"
)
MOBILE_PATTERN = r"(?<!\d)09\d{2}[-\s]?\d{3}[-\s]?\d{3}(?!\d)"
PARTY_LABELS = [
    "原告", "被告", "上訴人", "被上訴人", "訴訟代理人", "法定代理人",
    "代表人", "代理人", "參加人", "訴願人", "負責人", "聲請人", "相對人",
]
PARTY_TITLES = ["會計師", "律師", "記帳士", "專利師", "代理處長", "處長", "局長", "分局長", "主任", "經理", "科長"]
NOT_NAMES = [
    "遂於", "主張", "係第", "將系", "前於", "嗣於", "另於", "業於", "即於",
    "乃於", "雖稱", "辯稱", "遲至", "復於", "旋於", "始於", "並於", "如有",
]
SHORT_LINE_WORDS = [
    "主文", "事實", "理由", "附件", "說明", "要旨", "解釋文", "解釋爭點",
    "壹", "貳", "參", "肆", "全文", "教示", "決定書", "訴願人", "原處分機關",
]

# ---- citations -------------------------------------------------------------
LAW_SUFFIX = "(?:法|條例|細則|辦法|規則|準則|通則|標準|要點|自治條例)"
CITATION_PATTERN = (
    r"([一-鿿]{1,20}?" + LAW_SUFFIX + r")\s*"
    r"(?:§\s*(\d+)(?:\s*[之\-]\s*(\d+))?|第\s*(\d+)\s*條(?:\s*之\s*(\d+))?)"
)
MALFORMED_PATTERN = r"第\s*\d+\s*條\s*之\s*(?!\d)|第\s*條|§\s*(?!\d)"
MALFORMED_CONTEXT = 12
FOLLOW_ON_PATTERN = r"[及與或、,，和]\s*第\s*(\d+)\s*條(?:\s*之\s*(\d+))?"
ARTICLE_PATTERN = r"第\s*(\d+)\s*條(?:\s*之\s*(\d+))?"
REGISTERED_LAWS = [
    "訴願法", "行政程序法", "行政罰法", "行政訴訟法", "地方制度法",
    "洗錢防制法", "資恐防制法",
    "廢棄物清理法", "資源回收再利用法",
    "空氣污染防制法",
    "建築法", "噪音管制法", "水污染防治法", "土壤及地下水污染整治法",
    "環境教育法", "菸害防制法", "食品安全衛生管理法",
    "道路交通管理處罰條例", "電子遊戲場業管理條例", "都市計畫法",
]
LAW_LEAD_WORDS = [
    "訴願人", "原處分機關", "處分機關", "受處分人", "行為人", "申請人", "業者",
    "違反", "依據", "依照", "按照", "揆諸", "適用", "觸犯", "牴觸", "前揭", "上開",
    "依", "按",
]
PRONOUN_LAWS = ["本法", "該法", "同法", "前法", "新法", "舊法", "母法", "此法"]
VARIANTS_FROM, VARIANTS_TO = "汙台", "污臺"
FULLWIDTH_DIGITS, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"

# ---- document numbers and amounts ------------------------------------------
DOC_NO_PATTERN = r"([一-鿿]{2,8}字第\s*[0-9A-Za-z]+\s*號)"
DOC_NO_LEADING = "依按以經爰查就對為之日號起"
AMOUNT_PATTERN = r"(?:新臺幣|新台幣|罰鍰)?\s*([\d,]+)\s*(萬)?\s*元"
AMOUNT_FLOOR = 1000
AMOUNT_TEN_THOUSAND = 10000

# ---- dates and periods -----------------------------------------------------
ROC_OFFSET = 1911
AD_DATE_PATTERN = r"(\d{4})\s*[年./\-]\s*(\d{1,2})\s*[月./\-]\s*(\d{1,2})\s*日?"
ROC_DATE_PATTERN = r"(?:民國)?\s*(\d{2,3})\s*[年./\-]\s*(\d{1,2})\s*[月./\-]\s*(\d{1,2})\s*日?"
DATE_TOKEN_PATTERN = r"\d{2,4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日|\d{4}-\d{1,2}-\d{1,2}|\d{2,4}/\d{1,2}/\d{1,2}"
APPEAL_PERIOD_DAYS = 30
DEPOSIT_SERVICE_DAYS = 10
LIMITATION_YEARS = 3
ADULT_AGE = 18
DEPOSIT_WORD = "寄存"
TRUE_WORDS = ["true", "1", "yes", "是", "已撤銷", "已決定"]

# ---- gates, templates and notices ------------------------------------------
DISMISS = "訴願駁回"
REVOKE = "原處分撤銷，另為適法之處分"
INADMISSIBLE = "訴願不受理"
CLAUSE_TEMPLATES = {
    "1": (["訴願法第77條第1款"],
          "本件訴願書不合法定程式，經通知補正而屆期未補正，揆諸訴願法第77條第1款規定，應不受理。"),
    "2": (["訴願法第14條", "訴願法第77條第2款"],
          "{overdue}揆諸訴願法第14條第1項及第77條第2款規定，應不受理。"),
    "3": (["訴願法第18條", "訴願法第77條第3款"],
          "本件訴願人非原行政處分之相對人，亦非法律上之利害關係人，當事人不適格，揆諸訴願法第18條及第77條第3款規定，應不受理。"),
    "4": (["訴願法第77條第4款"],
          "本件訴願人無訴願能力而未由法定代理人代為訴願行為，經通知補正逾期未補正，揆諸訴願法第77條第4款規定，應不受理。"),
    "6": (["訴願法第77條第6款"],
          "本件行政處分已不存在，揆諸訴願法第77條第6款規定，應不受理。"),
    "7": (["訴願法第77條第7款"],
          "本件係對已決定或已撤回之訴願事件重行提起訴願，揆諸訴願法第77條第7款規定，應不受理。"),
    "8": (["訴願法第77條第8款"],
          "本件所爭執之標的非屬行政處分，或屬依法不得提起訴願之事項，揆諸訴願法第77條第8款規定，應不受理。"),
}
CLAUSE_GENERIC_TEXT = "本件因具訴願法第77條所定不受理事由，應不受理。"
CLAUSE_GENERIC_CITE = "訴願法第77條"
REMEDY_NOTICE = "訴願人如不服本決定，得於本決定書送達之次日起2個月內，向臺北高等行政法院地方行政訴訟庭提起行政訴訟。"

# ---- verification ----------------------------------------------------------
REMEDY_REQUIRED = ["行政訴訟"]
REMEDY_PERIODS = ["2個月", "二個月", "２個月"]
ABOLISHED_COURTS = [
    "臺灣臺北地方法院行政訴訟庭",
    "臺灣新北地方法院行政訴訟庭",
    "台灣臺北地方法院行政訴訟庭",
    "台灣新北地方法院行政訴訟庭",
    "臺灣省政府訴願審議委員會",
]
RULING_WORDS = {"inadmissible": "不受理", "revoke": "撤銷", "dismiss": "駁回"}
CONTRADICTIONS = {
    "dismiss": ["原處分撤銷", "應予撤銷", "原處分違法", "撤銷原處分"],
    "revoke": ["訴願駁回", "應予維持", "並無違誤", "洵無違誤", "尚無不合"],
    "inadmissible": ["實體審究", "本案實體"],
}
CHECK_NAMES = {
    "V1": "引用法條在可引用清單內",
    "V2": "內文條號均已宣告於 cites",
    "V3": "條號書寫格式正確（含之N）",
    "V4": "訴願主張全部獲回應",
    "V5": "引用條文於行為時有效",
    "V6": "理由日期均見於案件事實",
    "V7": "訴願期間計算一致",
    "V8": "教示記載完備且法院名稱有效",
    "V9": "主文與理由結論一致",
    "V10": "健檢紅燈已於理由處理",
}
FIX_HINTS = {
    "V1": " 請僅使用【可引用法條】清單內的條文，刪除清單外的引用。",
    "V3": " 請將條號寫完整（例如「第15條之2」不可寫成「第15條之」或「第條」）。",
    "V4": " 請為未回應的主張各補一段回應，並於 responds_to 標注其編號。",
    "V5": " 請改引用行為時有效之條文版本。",
    "V7": " 請確認訴願期間計算，並使主文與程序判斷一致。",
    "V8": " 請依現行審判機關名稱與 2 個月起訴期間更正教示。",
    "V9": " 請調整理由結論用語，使其與主文方向一致。",
}

# ---- issues ----------------------------------------------------------------
ROUTE_ISSUES = {
    "money_laundering": ["交付帳戶有無正當理由", "主觀故意過失(行政罰法§7)"],
    "waste": ["行為人認定", "共有人連帶責任", "是否屬廢棄物"],
    "air_pollution": ["定檢通知是否合法送達", "車輛是否已過戶或報廢"],
    "building": ["違規使用認定", "公安申報義務", "簽證內容不實"],
    "noise": ["檢測程序是否合法", "行為人認定", "超標認定"],
    "general": ["從新從輕(行政罰法§5)", "權利保護必要", "行政程序再開"],
}
COMMON_ISSUES = [
    "從新從輕(行政罰法§5)",
    "主觀故意過失(行政罰法§7)",
    "權利保護必要",
    "行政程序再開",
    "比例原則",
    "正當法律程序(陳述意見機會)",
]

# ---- retrieval -------------------------------------------------------------
ROUTE_BONUS = 1.25
DISPOSITION_PATTERNS = [("訴願不受理", "不受理"), ("原處分撤銷", "撤銷"), ("訴願駁回", "駁回")]
DISPOSITION_HEAD = 200
YEAR_HEAD = 120
YEAR_PATTERN = r"(\d{2,3})\s*年度?"
SUMMARY_LIMIT, REASON_LIMIT = 200, 120
QUERY_LIMIT = 500

# ---- triage ----------------------------------------------------------------
ANSWER_COLUMNS = ["受理與否", "不受理款次", "判定理由", "實體結果", "逾期天數"]
GONE_WORDS = ["已執行完畢", "消滅", "已不存在", "已撤銷", "已失效", "已廢止", "失效", "撤銷"]
TRIAGE_ACCEPT = "程序要件具備,無不受理事由,應予受理進入實體審查。"
# rules in order: clause, alternatives (each a list of words that occur together), reason
TRIAGE_RULES = [
    ("77(1)", [["未具備法定應記載事項"], ["程式", "未補正"], ["經通知仍未補正"]], "訴願書未具備法定應記載事項,經通知仍未補正。"),
    ("77(4)", [["未成年"], ["無訴願能力"], ["未由法定代理人"]], "訴願人無訴願能力(未成年且未由法定代理人代為訴願)。"),
    ("77(3)", [["無關第三人"], ["非利害關係"], ["當事人不適格"]], "訴願人非原處分相對人或利害關係人,當事人不適格。"),
    ("77(8)", [["非屬行政處分"], ["非行政處分"]], "所爭執標的性質上非屬行政處分。"),
    ("77(6)", [["已執行完畢消滅"], ["原處分已不存在"]], "原處分已不存在(現況:%s)。"),
    ("77(7)", [["前曾就同一事件提起訴願"], ["重行提起"], ["重復提起"]], "就同一事件重複提起訴願。"),
]
TRIAGE_GONE_DEFAULT = "已不存在"
TRIAGE_LATE = "提起訴願逾法定 %s 日期間(實際 %s 日,逾期 %s 日)。"
TRIAGE_DATE = r"民國\s*\d+\s*年\s*\d+\s*月\s*\d+\s*日"
TRIAGE_SERVED = rf"({TRIAGE_DATE})\s*送達"
TRIAGE_FILED = rf"於\s*({TRIAGE_DATE})\s*提起訴願"
TRIAGE_STATUS = "原處分現況為[「\"]([^」\"]+)[」\"]"
PDF_TRIAGE_RULES = [
    ("77(1)", [["通知", "補正", "未補正", "空白"], ["通知", "補正", "未補正", "應記載事項"]], "訴願書未具備法定應記載事項,經通知後仍未補正。"),
    ("77(4)", [["未成年", "未由法定代理人"], ["未成年", "無法定代理人"], ["未成年", "未經法定代理"]], "訴願人無訴願能力(未成年且未由法定代理人代為訴願)。"),
    ("77(4)", [["無訴願能力"]], "訴願人無訴願能力。"),
    ("77(3)", [["無關第三人"], ["非利害關係人"], ["當事人不適格"], ["與原處分並無法律上利害關係"]], "訴願人非原處分相對人或利害關係人,當事人不適格。"),
    ("77(8)", [["非屬行政處分"], ["非行政處分"], ["觀念通知"]], "所爭執標的性質上非屬行政處分。"),
    ("77(6)", [["效力已消滅"], ["執行完畢", "消滅"], ["原處分已撤銷"], ["已失效"], ["已廢止"]], "原處分已不存在(執行完畢/撤銷/失效,效力已消滅)。"),
    ("77(7)", [["前曾就同一事件提起訴願"], ["重行提起"], ["重複提起"], ["業經決定確定", "同一事件"]], "就同一事件重複提起訴願。"),
]
PDF_DATE = r"民國\d+年\d+月\d+日"
PDF_SERVED = [rf"收受知悉行政處分之年月日({PDF_DATE})", rf"於({PDF_DATE})收受"]
PDF_FILED = [rf"中華({PDF_DATE})", rf"於({PDF_DATE})提出本件訴願"]
PDF_STATED = r"距收受原處分之日已(\d+)日"
PDF_LATE = "提起訴願逾法定 30 日期間(%s %s 日,逾期 %s 日)。"
PDF_LATE_OWN, PDF_LATE_STATED = "實際", "訴願書載明已"

# ---- gate and findings -----------------------------------------------------
GATE_REASONS = {
    "77-2": "提起訴願日（%s）逾法定期間末日（%s）%s 日，依訴願法第77條第2款應不受理。",
    "77-6": "原行政處分已經撤銷或失效，依訴願法第77條第6款應不受理。",
    "77-7": "就同一處分前已提起訴願並經決定或撤回，依訴願法第77條第7款應不受理。",
}
REQUIRED_FIELDS = {"agency": "處分機關", "disposition_date": "處分作成日期", "doc_no": "處分書字號", "legal_basis": "法令依據"}
# check: title, basis, evidence, suggested effect
FINDINGS = {
    "D1": ("原處分應記載事項不完備", "行政程序法第96條第1項", "缺漏：%s", "原處分撤銷，命補正應記載事項"),
    "D2": ("裁處已逾裁處權時效", "行政罰法第27條第1項（3年）", "處分作成日 %s 逾時效末日 %s 共 %s 日", "原處分撤銷（裁處權已消滅）"),
    "D3": ("累犯次數與罰鍰金額宜複核", "裁罰基準表", "宣稱累犯 %s 次、罰鍰 %s，請對照裁罰基準確認級距", ""),
    "D4": ("應審酌從新從輕原則", "行政罰法第5條", "行為時 %s 與裁處時 %s 跨越法規可能修正之期間，應比較行為時法與裁處時法擇有利者", ""),
    "D5": ("未完成法定前置程序即為裁處", "各該作用法之前置程序規定", "本案需先行限期改善／令停工等前置處分，卷內查無完成紀錄", "原處分撤銷，補正前置程序"),
    "D6": ("原處分送達日期不明", "行政程序法第72條以下", "卷內查無合法送達日期，救濟期間無從起算", ""),
}
OVERDUE_DATED = "本件原行政處分於%s發生送達效力，訴願人遲至%s始提起訴願，已逾法定30日訴願期間（末日為%s）；"
OVERDUE_UNDATED = "本件訴願之提起已逾法定30日訴願期間；"

# ---- petition fields -------------------------------------------------------
PETITION_AGENCY_LABEL = "原行政處分機關"
PETITION_RAW_PATTERNS = {
    "petitioner": r"訴願人\s*\n?\s*([^\n]{1,30}?)(?:\n|民國|（)",
    "agency": r"原行政處分機關\s*\n\s*([^\n]+)",
    "appeal_agency": r"受理訴願機關\s*\n\s*([^\n]+)",
    "request": r"訴願請求事項[:：]\s*\n?\s*([^\n]+)",
}
PETITION_FLAT_PATTERNS = {
    "doc_no": r"(新北\S{0,6}字第\d+號)",
    "issued": r"發文日[:：]?(民國\d+年\d+月\d+日)",
    "received": r"收受知悉行政處分之年月日(民國\d+年\d+月\d+日)",
    "filed": r"中華(民國\d+年\d+月\d+日)",
}
PETITION_BIRTH_PATTERN = r"(民國\d+年\d+月\d+日)"
COMPANY_WORDS = ["統一編號", "有限公司"]
PETITION_SECTIONS = {
    "facts": ("事實：", ["理由：", "檢附之證據"]),
    "reasons": ("理由：", ["檢附之證據", "此致"]),
    "evidence": ("檢附之證據或附件：", ["此致"]),
}

# ---- output texts ----------------------------------------------------------
BASIS_RED = "原處分健檢發現 %s 項重大瑕疵，傾向撤銷"
BASIS_MAJORITY = "相似歷史案例多數為「%s」"
BASIS_NONE = "無明顯瑕疵且無相似案例可參，暫採駁回為參考"
BASIS_FRONT = "前段判定程序不受理（快速通道，未進實體審查）"
BASIS_GATE = "後段程序審查判定不受理（§%s）：%s"
CLAUSE_UPSTREAM = "（前段判定：%s）"
HIGH_CONFIDENCE = "高"
CAPACITY_CLAUSE = "77(4)"
CAPACITY_NOTE = "【防呆】覆核以77(4)無訴願能力為由不受理,惟依訴願書所載出生年月日%s計算,提起訴願時為%s歲%s%s,訴願能力無欠缺,故不採用該覆核結論,回歸初判。"
CAPACITY_ADULT, CAPACITY_COMPANY = "(已成年)", "/訴願人為法人"
CATEGORY_BY_MODEL = "LLM判定:%s;%s"
CATEGORY_BY_WORDS = "關鍵詞命中: %s"
CATEGORY_NOT_ACCEPTED = "不受理案件,類別註記為0"
CONTRACT_VERSION = "schema_version 應為 %s"
CONTRACT_ROUTE = "route_key '%s' 不在枚舉"
CONTRACT_MISSING = "缺少必填欄位 %s"
REMEDY_NO_WORD = "教示未載明「%s」"
REMEDY_NO_PERIOD = "教示未載明 2 個月起訴期間"
REMEDY_ABOLISHED = "引用已改制/裁撤之機關：%s"
ISSUE_SENTENCE = "%s未通過：%s%s"
CONCERNING = "（涉及：%s）"
UNLISTED = "有 %s 項引用不在可引用清單內，須確認是否捏造。"
BROKEN_ARTICLES = "內文有 %s 處條號寫法不完整（如「條之」缺數字）。"
UNANSWERED = "共 %s 項主張，%s 項未獲回應。"
NOT_EFFECTIVE = "有 %s 項引用於行為日（%s）尚未生效或已刪除。"
PERIOD_COUNTED = "送達 %s → 提起 %s，經過 %s 日（法定 %s 日）。"
PERIOD_REVERSED = " 提起日早於送達日，日期資料矛盾。"
PERIOD_MISSED = " 已逾法定期間，但主文非「不受理」，請確認是否漏判逾期。"
CONTRADICTED = "主文為「%s」，但理由出現相反結論用語 %s。"
ATTACK_LINE = "[%s] %s — 修正方向：%s"
FLAG_CONFIDENCE = "前段分類信心不足（need_human_review）"
FLAG_RED, FLAG_RED_AGAIN = "驗證紅燈未通過：%s", "重寫後仍有驗證紅燈：%s"
FLAG_REVIEW = "法官對抗式審查未通過"
FLAG_RISK = "對抗式審查撤銷風險：%s"
FLAG_REWRITTEN = "已自動重寫 %s 次"
COPY_SUFFIX_PATTERN = r"\.pdf 的副本\.pdf\z"
FILE_NAME_PATTERN = r"^(\d+)\.(\d{3})年-(.+)\z"
# headings of rendered documents, with the field each shows
DECISION_HEAD = {
    "case_number": "案號：", "title": "案由：", "law_category": "法規類別：", "source_law": "實際案由：",
    "dispatch_number": "決定書字號：", "publish_date": "決定日期：", "ruling": "主文：",
    "original_agency": "原處分機關：", "articles": "相關法條：",
}
DECISION_BODY = {"facts": "【事實】\n", "reasons": "【理由】\n", "remedy": "【教示】\n"}
DECISION_WHOLE = "【全文】\n"
STATUTE_HEAD = "法規名稱：%s\n最新修正：%s\n\n"
REFERENCE_HEAD = "標題：%s\n\n"
