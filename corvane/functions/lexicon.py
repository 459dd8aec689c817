"""Patterns, word lists and tables that results depend on, in the order in which they are tried."""

# -- chunk signals (fixed values) ---------------------------------------------------------------------------------------
NUMERIC_CLAIM = (
    r"(?i)(?:\d[\d,]*\.?\d*\s*(?:%|MW|GW|kW|TWh|GWh|MWh|°C|°F|(?:USD|GBP|EUR|\$|€|£)\s*(?:billion|million|thousand|bn|mn|k)?"
    r"|(?:billion|million|thousand)\s*(?:dollars|pounds|euros)?|(?:TB|GB|PB)/s|(?:PUE|CUE|WUE)|years?|months?|MW(?:th|e)?|tons?|tonnes?))"
)
UNIT = (
    r"(?i)\b(?:MW|GW|kW|TWh|GWh|MWh|kWh|kV|MV|GV|MW(?:th|e)|GHz|MHz|THz|GB/s|TB/s|PB/s|(?:bn|mn)\b|billion|million|trillion"
    r"|(?:USD|GBP|EUR)\b|PUE|CUE|WUE|GPUs?|TPUs?|CPUs?|ASICs?|racks?|servers?)\b"
)
DATE = (
    r"(?i)\b(?:20\d{2}|19\d{2})\b|Q[1-4]\s*20\d{2}|\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    r"|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+20\d{2}\b"
)
COMPARATIVE = (
    r"(?i)\b(?:more|less|higher|lower|greater|fewer|faster|slower|larger|smaller)\s+than\b|\bcompared\s+(?:to|with)\b|\bvs\.?\s+\w"
    r"|\bversus\b|\bunlike\b|\bwhile\b.*\bwhereas\b|\brelative\s+to\b"
)
POLICY = (
    r"(?i)\b(?:FERC|NERC|ERCOT|PJM|MISO|CAISO|SPP|NYISO|ISO-NE|IEEE|ASHRAE|NFPA|NEC|IEC|DOE|EPA|CPUC|PUCT|NARUC|Order\s+\d{3,4}"
    r"|interconnection\s+(?:queue|process|agreement)|transmission\s+(?:planning|operator|owner)|renewable\s+portfolio\s+standard"
    r"|IRA|Inflation\s+Reduction\s+Act|ISO\s+\d{2,5}|IEC\s+\d{2,5}|ANSI)\b"
)
NAMED_ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b[A-Z]{2,}\b"
TOC = (
    r"(?i)table\s+of\s+contents",
    r"(?im)^\s*contents\s*$",
    r"(?:\d+\s+){3,}\d+",
    r"\.{4,}\s*\d+",
    r"(?:^|\n)\s*\d{1,3}\s+[A-Z][^\n]{0,60}\n\s*\d{1,3}\s+[A-Z]",
)
LEGAL = (
    r"(?i)all rights reserved",
    r"(?i)©\s*\d{4}",
    r"(?i)copyright\s+\d{4}",
    r"(?i)confidential\s+and\s+proprietary",
    r"(?i)no part of this\s+(?:publication|document|report)",
    r"(?i)without\s+(?:the\s+)?(?:prior\s+)?written\s+permission",
    r"(?i)terms\s+and\s+conditions",
    r"(?i)liability\s+disclaimer",
    r"(?i)this\s+document\s+(?:is\s+)?(?:provided|intended)\s+for\s+informational",
)
NAVIGATION = (
    r"(?i)page\s+\d+\s+of\s+\d+",
    r"(?i)click\s+here\s+to",
    r"(?i)(?:forward|back|next|previous)\s+page",
    r"(?im)^\s*(?:figure|table|exhibit)\s+\d+\.?\s*$",
    r"(?im)^\s*(?:notes?|source|sources?):\s*$",
    r"(?i)(?:nav(?:igation)?|menu|header|footer)\b",
    r"(?m)^\s*\d{1,3}\s*$",
)
REFERENCES = (
    r"(?i)references?\s*\n",
    r"(?i)bibliography\s*\n",
    r"(?i)works\s+cited\s*\n",
    r"(?m)^\s*\[\d+\]\s+",
    r"(?im)^\s*\d+\.\s+[A-Z][^.]{10,}\.\s*(?:doi|http|www|isbn)",
    r"(?i)doi:\s*10\.\d{4}/",
)
HARD_BOILERPLATE = (
    r"(?i)table\s+of\s+contents",
    r"(?i)all rights reserved",
    r"(?i)©\s*\d{4}",
    r"(?i)copyright\s+\d{4}",
    r"(?i)confidential\s+and\s+proprietary",
    r"(?im)^\s*(?:\[\d+\]|\d+\.)\s+[A-Z].*doi:",
)
PRIORITY_HEADERS = (
    r"(?i)executive\s+summary",
    r"(?i)key\s+(?:findings|results|takeaways|insights|conclusions)",
    r"(?i)\bconclusions?\b",
    r"(?i)\brecommendations?\b",
    r"(?i)market\s+outlook",
    r"(?i)scenario\s+analysis",
    r"(?i)technology\s+roadmap",
    r"(?i)cost\s+(?:estimates?|analysis|projections?|breakdown)",
    r"(?i)policy\s+implications?",
    r"(?i)investment\s+(?:outlook|analysis|opportunities?)",
    r"(?i)technical\s+specifications?",
    r"(?i)performance\s+(?:metrics|data|benchmarks?)",
    r"(?i)financial\s+(?:projections?|analysis|results?)",
)
PRIORITY_BOOST = {"high": 1.0, "medium": 0.5, "low": 0.0, "skip": -999.0}

# -- evidence types (fixed values) --------------------------------------------------------------------------------------
EVIDENCE_TYPES = (
    ("comparison", r"(?i)\b(more than|less than|higher than|lower than|greater than|compared to|unlike|whereas|by contrast|in contrast|outperforms|exceeds|surpasses|vs\.?|versus|relative to|advantage over|disadvantage compared)\b"),
    ("causal", r"(?i)\b(because|due to|as a result|therefore|thus|hence|leads? to|results? in|causes?|enables?|prevents?|delays?|limits?|driven by|triggered by|attributable to|owing to|shortage[s]? .{0,30}delay|supply .{0,20}constrain)\b"),
    ("risk", r"(?i)\b(risk|challenge|barrier|uncertain|unlikely|may fail|concern|threat|vulnerability|exposure|hazard|danger|problematic|difficult|if not|could jeopardize|at risk)\b"),
    ("forecast", r"(?i)\b(will|expect(?:ed|s)?|project(?:ed|s)?|anticipate[sd]?|forecast[s]?|by 20\d\d|target[s]?|plan(?:ned|s)?|goal|aim[s]?|predict(?:ed|s)?|trajectory|outlook|future)\b"),
    ("constraint", r"(?i)\b(limited by|depends on|dependent on|requires?|must|cannot|constrained|bottleneck|cap(?:acity)? constraint|insufficient|inadequate|lacking|shortage)\b"),
    ("timeline", r"(?i)\b(\d{1,2}[-–]\d{1,2}\s*years?|\d+\s*months?|\d+\s*years?|quarter[s]?|schedule|duration|timeline|by Q[1-4]|first concrete|commissioning date|completion date|construction period|build time)\b"),
    ("metric", r"(?i)\b\d[\d,.]*\s*(?:(?:kw|mw|gw|kwh|mwh|gwh|kwt|mwt|gwt|kwe|mwe|gwe|tb/s|gb/s|mb/s|gpu[s]?|cpu[s]?|gb|tb|pb|percent|usd|billion|million|trillion|years?|months?|weeks?|days?|degrees?|°[cf]|celsius|fahrenheit|bar|psi|atm|pascal|liter[s]?|gallon[s]?|watt[s]?|ampere[s]?|volt[s]?|tonne[s]?|ton[s]?|kg|pound[s]?|meter[s]?|km|mile[s]?|rpm|hz|khz|mhz|ghz)\b|%|\$|€)"),
)
CROSS_COMPARISON = r"(?i)\bcontradict(?:s|ed|ing|ion|ions|ory)?\b|\binconsistent\b|\bconflicting\b|\bconflicts?\s+with\b|\bin\s+contrast\s+to\b|\bunlike\s+(?:the\s+)?(?:other|previous|earlier|above|another)\b|\bdisagree[sd]?\s+with\b|\bin\s+disagreement\s+with\b"
ADMINISTRATIVE = ("document number", "doc number", "document id", "report number", "is revision", " rev.", "document is revision", "document is rev", "is copyrighted", "copyright", "all rights reserved", "is a trademark", "is a registered trademark", "trademark of", "trademark license", "used under trademark", "table of contents", "acknowledgement", "acknowledgment", "for internal use only", "proprietary information", "document is ", "this document is ", "document are ", "pages long", "page document", "isbn", "issn", "catalog number", "catalogue number")
PROVENANCE = ("authored by", "written by", "published by", "prepared by", "produced by", "prepared for", "submitted to", "this study was", "this report was", "this paper was")
TECHNICAL_CATEGORIES = ("technical", "specification", "engineering", "performance", "design", "safety", "thermal", "nuclear", "reactor", "fuel")
TECHNICAL_UNIT = r"(?i)\d+(?:\.\d+)?\s*(?:mw[eth]?|kw[eth]?|gw[eth]?|°[cf]|psi|bar|mpa|kpa|kg|lb|t\b|mt\b|m³|m3|mwh|kwh|gwh|%|hz|rpm|mm\b|cm\b|km\b|m\b|years?\b|months?\b|days?\b|hours?\b|usd|\$)"
#: evidence type -> retrieval enabled, priority, strategic value
RETRIEVAL_DEFAULTS = {"STRATEGIC": (True, 5, 0.80), "TECHNICAL": (True, 4, 0.60), "PROVENANCE": (False, 2, 0.20), "ADMINISTRATIVE": (False, 1, 0.05)}
RECOVERY_REASONS = (
    ("numeric_claim", r"(?i)(?:\$?\d[\d,]*\.?\d*\s*(?:%|MW|GW|kW|TWh|GWh|MWh|kWh|°C|°F|USD|GBP|EUR|billion|million|trillion|bn|mn|GB/s|TB/s|PB/s|PUE|CUE|WUE|years?|months?|days?|tons?|tonnes?))"),
    ("policy_claim", r"(?i)\b(?:FERC|NERC|ERCOT|PJM|MISO|CAISO|SPP|NYISO|ISO-NE|IEEE|ASHRAE|NFPA|NEC|IEC|DOE|EPA|CPUC|PUCT|NARUC|Order\s+\d{3,4}|interconnection\s+(?:queue|process|agreement)|Inflation\s+Reduction\s+Act|IRA\b)"),
    ("timeline_claim", r"(?i)\b(?:20\d{2}|19\d{2})\b|Q[1-4]\s*20\d{2}|\b\d+[\-–]\d+\s+(?:years?|months?|weeks?)\b"),
    ("technical_spec", r"(?i)\b(?:\d+\s*(?:kW|MW|GW|kWh|MWh|GWh|TWh)|\d+\s*(?:GB|TB|PB)/s|\d+\s*(?:rack|cabinet|server|node|GPU|TPU)|PUE\s*(?:of\s*)?[\d\.]+|[A-Z]+\s*(?:standard|specification|requirement|compliance))"),
    ("market_projection", r"(?i)\b(?:(?:market|demand|capacity|revenue)\s+(?:will|expected|projected|forecast|estimated)\s+(?:to\s+)?(?:reach|grow|increase|exceed)|(?:CAGR|compound\s+annual\s+growth\s+rate)|(?:by\s+20\d{2})\s*(?:,\s*)?(?:the\s+)?(?:market|demand|capacity))"),
    ("grid_constraint", r"(?i)\b(?:(?:transmission|grid|interconnection)\s+(?:constraint|limit|congestion|bottleneck|delay|backlog)|(?:interconnection\s+queue\s+(?:of|at|exceeds|reached)\s+\d)|(?:stranded\s+(?:asset|capacity|investment))|(?:curtail(?:ment|ed)))"),
)

#: Forms of patterns that match the same in less time: alternatives by first letter behind one look at it and one word
#: boundary; numbers are not given back, as no unit begins with a digit, a comma, a dot or a blank.
FASTER = {
    NUMERIC_CLAIM: NUMERIC_CLAIM.replace(r"\d[\d,]*\.?\d*\s*(?:", r"\d[\d,]*+\.?+\d*+\s*+(?:", 1),
    UNIT: (
        r"(?i)(?=[mgktpbuecwars])\b(?:m(?:wh|w(?:th|e)?|v|hz|n|illion)|g(?:wh?|v|hz|b/s|bp|pus?)|k(?:wh?|v)|t(?:wh|hz|b/s|rillion|pus?)"
        r"|p(?:b/s|ue)|b(?:n|illion)|usd|eur|c(?:ue|pus?)|wue|asics?|racks?|servers?)\b"
    ),
    DATE: (
        r"(?i)(?=[12qjfmasond])(?:\b(?:20\d{2}|19\d{2})\b|q[1-4]\s*20\d{2}|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
        r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+20\d{2}\b)"
    ),
    COMPARATIVE: (
        r"(?i)(?=[mlhgfscvuwr])\b(?:(?:more|less|higher|lower|greater|fewer|faster|slower|larger|smaller)\s+than\b|compared\s+(?:to|with)\b|vs\.?\s+\w"
        r"|versus\b|unlike\b|while\b.*\bwhereas\b|relative\s+to\b)"
    ),
    POLICY: (
        r"(?i)(?=[fnepmcsiadotr])\b(?:ferc|n(?:erc|yiso|fpa|ec|aruc)|e(?:rcot|pa)|p(?:jm|uct)|miso|c(?:aiso|puc)|spp"
        r"|i(?:so-ne|eee|ec|ra|so\s+\d{2,5}|nterconnection\s+(?:queue|process|agreement)|nflation\s+reduction\s+act)|a(?:shrae|nsi)|doe|order\s+\d{3,4}"
        r"|transmission\s+(?:planning|operator|owner)|renewable\s+portfolio\s+standard)\b"
    ),
}
#: What a text must hold for a pattern to match: one of these in lower case, or with DIGIT a digit.
DIGIT = ("[0-9]",)
NEEDS = {
    **dict(zip(TOC, (("contents",), ("contents",), DIGIT, ("....",), DIGIT), strict=True)),
    **dict(zip(LEGAL, (("all rights reserved",), ("©",), ("copyright",), ("confidential",), ("no part of this",), ("permission",), ("conditions",), ("disclaimer",), ("informational",)), strict=True)),
    **dict(zip(NAVIGATION, (("page",), ("click",), ("page",), ("figure", "table", "exhibit"), ("note", "source"), ("nav", "menu", "header", "footer"), DIGIT), strict=True)),
    **dict(zip(REFERENCES, (("reference",), ("bibliography",), ("works",), ("[",), ("doi", "http", "www", "isbn"), ("doi:",)), strict=True)),
    **dict(zip(PRIORITY_HEADERS, (("summary",), ("key",), ("conclusion",), ("recommendation",), ("outlook",), ("scenario",), ("roadmap",), ("cost",), ("polic",), ("investment",), ("specification",), ("performance",), ("financial",)), strict=True)),
    COMPARATIVE: ("than", "compared", "vs", "versus", "unlike", "whereas", "relative"),
    HARD_BOILERPLATE[4]: ("confidential",),
    HARD_BOILERPLATE[5]: ("doi:",),
}

# -- claims: scope, kind, context, milestones (fixed values) ---------------------------------------------------------------
SCOPES = (
    ("component", r"(?i)\bgpu\s+chip\b|\bchip\s+(?:power|tdp|die)\b|\bper\s+(?:gpu|chip|die)\b"),
    ("component", r"(?i)power shelf| psu|power supply unit|power supply|module bay| drawer|power module|network module| shelf|shelf module"),
    ("tray", r"(?i)compute tray|power tray|cooling tray| tray|mgx tray|mgx module|nvswitch tray"),
    ("node", r"(?i)\bgpu\b|\bcpu\b|\bsoc\b|\bnpu\b"),
    ("rack", r"(?i) rack|nvl72|nvl36|gb200 nvl|mgx rack|mgx system|server rack|compute rack"),
    ("node", r"(?i) node|server node|gpu node|compute node|per server|each server"),
    ("cluster", r"(?i)cluster|data center|datacenter|data-center| pod |row of rack|row of server"),
    ("facility", r"(?i)facility|campus|data centre|building"),
    ("unit", r"(?i)\breactor\s*(?:unit)?\b|\bunit\s+\d\b|\bblock\s+\d\b|\bsmr\s+unit\b"),
    ("site", r"(?i)reactor site|plant site|construction site|nuclear site"),
    ("fleet", r"(?i) fleet|fleet-wide|multiple reactor|all reactor|reactor fleet"),
    ("country", r"(?i)\bnational\b|\bnation-wide\b|\bcountry.?wide\b|\bprovince\b|\bregional\b"),
)
ENTITY_TYPE_SCOPE = {"rack_system": "rack", "reactor": "unit", "power_subsystem": "component", "compute_subsystem": "component", "cooling_subsystem": "component"}
INCOMPATIBLE_SCOPES = (
    ("component", "rack"), ("component", "tray"), ("component", "node"), ("component", "cluster"), ("component", "facility"), ("tray", "rack"), ("tray", "cluster"), ("tray", "facility"),
    ("node", "rack"), ("node", "cluster"), ("node", "facility"), ("rack", "cluster"), ("rack", "facility"), ("cluster", "facility"), ("unit", "fleet"), ("unit", "country"), ("unit", "province"), ("site", "fleet"),
)
#: pattern, name ({1} is the first group; u: upper case, t: title case), type
ENTITIES = (
    (r"(?i)\bgb200\s+nvl(\d+)\b", "GB200 NVL{1}", "", "rack_system"),
    (r"(?i)\bnvl(\d+)\b", "NVL{1}", "", "rack_system"),
    (r"(?i)\bblackwell\s+(?:ultra\s+)?(?:nvl\d+\s+)?(?:rack|system)\b", "Blackwell Rack", "", "rack_system"),
    (r"(?i)\bhopper\s+(?:nvl\d+\s+)?(?:rack|system)\b", "Hopper Rack", "", "rack_system"),
    (r"(?i)\b(hgx\s*[a-z]?\d{2,3})\b", "{1}", "", "rack_system"),
    (r"(?i)\b(dgx\s*[a-z]?\d+)\b", "{1}", "", "rack_system"),
    (r"(?i)\b(bwrx-?\d+)\b", "{1}", "u", "reactor"),
    (r"(?i)\b(xe-\d+[a-z]*)\b", "{1}", "u", "reactor"),
    (r"(?i)\b(smr-\d+[a-z]*)\b", "{1}", "u", "reactor"),
    (r"(?i)\bnuscale\s+(?:smr|power\s+module|voygr)\b", "NuScale SMR", "", "reactor"),
    (r"(?i)\breactor\s+(?:unit\s+)?([a-z][a-z0-9]*|\d+)\b", "Reactor {1}", "t", "reactor"),
    (r"(?i)\b(?:unit|block)\s+(\d+)\b", "Unit {1}", "", "reactor"),
    (r"(?i)\bpower\s+shelf\b", "Power Shelf", "", "power_subsystem"),
    (r"(?i)\b(?:psu|power\s+supply(?:\s+unit)?)\b", "PSU", "", "power_subsystem"),
    (r"(?i)\bcompute\s+tray\b", "Compute Tray", "", "compute_subsystem"),
    (r"(?i)\bcooling\s+tray\b", "Cooling Tray", "", "cooling_subsystem"),
    (r"(?i)\bthe\s+rack\b", "Rack", "", "rack_system"),
)
RATE = r"(?i)per\s+year|/\s*year|per\s+annum|annually|per\s+month|/\s*month|throughput\b|licensing\s+rate|build\s+rate|install\s+rate"
TARGET = r"(?i)\bby\s+20[3-9]\d\b|target\b|goal\b|capacity\s+target|capacity\s+goal|total\s+capacity|cumulative\s+capacity"
PROJECTION = r"(?i)\bby\s+20[3-9]\d\b|\bproject(?:ed|ion)\b|\bforecast\b|\bexpect(?:ed)?\b|\bpipeline\b|\bplanned\b|\bproposes?\b|\broadmap\b|\bfuture\b"
CURRENT = r"(?i)\bcurrent\b|\btoday\b|\bexisting\b|\bpresent\b|\bnow\b|\boperating\b"
CONTEXTS = (
    ("example_deployment", r"(?i)\bfor\s+example\b|\bfor\s+instance\b|\be\.g\b|\billustrat\w+\b|\bhypothetical\b|\bconsider\s+a\s+(?:scenario|case|deployment)\b|\bexample\s+(?:deployment|data.cent\w*|facility|use.?case|rack)\b|\bsimple\s+example\b|\bsample\s+(?:deployment|rack)\b|\bsuch\s+as\s+(?:a|an)\b"),
    ("reference_architecture", r"(?i)\breference\s+(?:architecture|design|configuration|rack|deployment)\b|\bstandard\s+(?:configuration|rack|design|deployment)\b|\btypical\s+(?:rack|configuration|data.cent\w*|deployment|design)\b|\bcanonical\s+(?:rack|design|deployment)\b|\barchitecture\s+(?:calls?\s+for|requires?|specif\w+)\b"),
    ("industry_average", r"(?i)\bindustry\s+average\b|\baverage\s+(?:across|data.cent\w+|facility|rack)\b|\bmost\s+(?:data.cent\w+|facilities|deployments|hyperscalers?)\b|\btypically\s+(?:see|require|use|draw|consume|reach)\b|\bacross\s+the\s+industry\b|\bgenerally\s+(?:require|draw|consume|see)\b|\bindustry.wide\b|\bmarket\s+average\b|\bnorm\s+(?:is|for)\b"),
    ("vendor_claim", r"(?i)\bnvidia\s+(?:rates?|claims?|specif\w+|states?|announc\w+|sheet)\b|\bvendor\s+(?:spec|claim|rating|data.sheet)\b|\bdata\s+sheet\b|\bproduct\s+spec\w*\b|\bmanufacturer\s+(?:spec|claim|rating)\b|\bspec(?:ified|ification)\s+(?:calls?\s+for|states?|shows?|gives?)\b"),
)
INCOMPATIBLE_CONTEXTS = (
    ("example_deployment", "reference_architecture"), ("example_deployment", "current_deployment"), ("example_deployment", "future_projection"), ("example_deployment", "vendor_claim"),
    ("example_deployment", "industry_average"), ("vendor_claim", "industry_average"), ("current_deployment", "future_projection"),
)
MILESTONES = (
    ("construction_approval", r"(?i)\bconstruction\s+approv|\bpermit\b|\blicens\b|\bregulatory\s+approv"),
    ("construction_start", r"(?i)\bground.?break|\bfirst\s+concrete\b|\bconstruction\s+start"),
    ("civil_works", r"(?i)\bcivil\s+works?\b|\bsite\s+prep|\bexcavat"),
    ("equipment_installation", r"(?i)\bequipment\s+install|\bmodule\s+install|\bassembl"),
    ("fuel_loading", r"(?i)\bfuel\s+load|\bnuclear\s+first\s+light\b|\bfirst\s+criticality\b"),
    ("commercial_operation", r"(?i)commercial\s+operat|\bcommercial\s+service\b|\bcommission|\bgo.?live\b|\bpower\s+generat"),
    ("fleet_completion", r"(?i)\bfleet\s+(?:complet|deploy|target)|\ball\s+units?\s+(?:online|operat)"),
    ("year_event", r"(?i)\bconference\b|\bsummit\b|\bgtc\b|\bexpo\b|\bevent\b|\bwebinar\b|\bsymposium\b|\bannouncement\b|\bshow\b"),
    ("commercial_operation", r"(?i)commercial\s+operat|\boperational\b|\bonline\b|\bgo\s+live\b|\bdeployment\b|\bcommissioning\b|\bcommercial\s+service\b"),
    ("year_product", r"(?i)\blaunch\b|\brelease\b|\bplatform\b|\barchitecture\b|\bgeneration\b|\bavailable\b|\bavailability\b|\bship\b|\bshipping\b|\bproduct\b"),
    ("construction_approval", r"(?i)\bconstruction\b|\bground.?break|\bfirst\s+concrete\b|\bsite\s+prep|\bapproval\b|\bapproved\b|\bpermit\b|\blicensing\b"),
)
LIFECYCLE = ("construction_approval", "construction_start", "civil_works", "equipment_installation", "fuel_loading", "commercial_operation", "fleet_completion", "year_construction", "year_deployment")
THRESHOLD_BEFORE = r"(?i)(?:\bpower\s+densit\w+\s+above|\bdensit\w+\s+above|\binadequate\s+(?:for\s+\w+\s+)?above|\badequate\s+(?:for\s+\w+\s+)?below|\bbecomes?\s+\w+\s+(?:above|below)|\beffective\s+(?:up\s+to|below)|\bviable\s+(?:up\s+to|below)|\bthreshold\s+of|\blimit\s+of|\bup\s+to)\s*$"
HISTORICAL = r"(?i)\bcloud\s+era\b|\btraditional\b|\blegacy\b|\bconventional\b|\bprevious(?:ly)?\b|\bhistoric(?:al(?:ly)?)?\b|\bolder\s+generation\b|\bpre.(?:ai|gpu|generative|llm)\b|\bbefore\s+(?:ai|llm|gen\s*ai)\b|\btypically\s+operat\w+\b|\bstandard\s+(?:rack|server)\b|\b20[01]\d\s+era\b"
COMPARISON_CLAUSE = r"(?i)\bcompared\s+to\s+(?:traditional|conventional|standard|legacy|older|previous|typical)\b|\bversus\s+(?:traditional|conventional|standard)\b|\bunlike\s+(?:traditional|conventional|standard)\b"
#: units in the order in which they are compared (the order is ours: nothing else fixes it)
UNITS = ("kw", "mw", "gw", "w", "gpu", "tb", "gb", "°c", "c", "rack", "node", "%", "x")
UNIT_TOPIC = {"kw": "rack power", "mw": "rack power", "gw": "rack power", "°c": "cooling temperature", "c": "cooling temperature", "gpu": "gpu count"}
SCOPE_POWER = {"rack": "rack_power", "component": "power_shelf_power", "tray": "tray_power", "node": "node_power", "cluster": "cluster_power", "facility": "facility_power", "unit": "installed_capacity", "reactor": "installed_capacity", "fleet": "fleet_capacity"}
SCOPED_POWER = r"^(rack_power_|power_shelf_power_|tray_power_|node_power_|gpu_power_|cluster_power_|facility_power_|installed_capacity_|fleet_capacity_)"
#: contradiction topics of the profiles, in order
CONTRADICTION_TOPICS_AI_DC = (
    ("power", ("kw", "mw", "gw", "power", "watt", "consumption", "load")),
    ("cooling", ("cooling", "liquid cool", "air cool", "cdu", "heat rejection", "thermal")),
    ("networking", ("network", "bandwidth", "nvlink", "infiniband")),
    ("rack_architecture", ("rack", "nvl72", "nvl36", "gpu")),
    ("timeline", ("2025", "2026", "2027", "2028")),
    ("resiliency", ("redundancy", "backup", "failover")),
)
DISTINCT_PRODUCTS = (
    ("product_mismatch", ("nvl8",), ("nvl36",)),
    ("product_mismatch", ("nvl8",), ("nvl72",)),
    ("product_mismatch", ("nvl36",), ("nvl72",)),
    ("product_mismatch", ("dgx",), ("hgx",)),
    ("generation_progression", ("gb200", "blackwell", "b200", "b300", "b100"), ("rubin", "vera rubin", "r100")),
    ("generation_progression", ("hopper", "h100", "h200"), ("gb200", "blackwell", "b200", "b300")),
    ("generation_progression", ("hopper", "h100", "h200"), ("rubin", "vera rubin")),
)
EXCLUSIVE = (
    (("air cool", "air-cool", "air cooled", "air-cooled"), ("liquid cool", "liquid-cool", "water cool", "dlc", "direct liquid")),
    (("2025",), ("2026",)),
    (("2026",), ("2027",)),
    (("2027",), ("2028",)),
    (("2028",), ("2029",)),
    (("2029",), ("2030",)),
    (("2030",), ("2031",)),
    (("nvl72",), ("nvl36",)),
    (("72 gpu", "72-gpu"), ("144 gpu", "144-gpu")),
    (("single-phase", "single phase"), ("two-phase", "two phase")),
)
DURATION = r"(?i)\b(\d+)(?:\s*[-–]\s*(\d+))?\s*(months?|years?)"
DURATION_METRICS = (
    ("duration_construction", r"(?i)\bconstruction\b|\bbuild\b|\bsite\s+work\b|\binstall"),
    ("duration_licensing", r"(?i)\blicensing\b|\bregulatory\b|\breview\b|\bapproval\b|\bpermit"),
    ("duration_lead_time", r"(?i)\blead[\s-]time\b|\bprocurement\b|\bdelivery\b|\bmanufactur"),
)
DURATION_STOP = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "to", "of", "for", "in", "on", "at", "by", "from", "with", "and", "or", "not", "no", "its", "it", "that", "this", "these", "those", "can", "could", "will", "would", "may", "might", "must", "shall", "approximately", "about", "around", "roughly", "estimated", "expected", "projected", "anticipated", "typically", "usually", "often", "construction", "duration", "timeline", "schedule", "period", "time", "months", "years", "month", "year", "weeks", "days", "build", "commissioning", "licensing", "review", "approval", "completion", "deployment", "operation", "startup", "large", "small", "new", "first", "second", "next", "last", "initial", "planned", "proposed", "current", "historical", "traditional", "typical", "designed", "reactor", "nuclear", "plant", "facility")

# -- retrieval (fixed values) ---------------------------------------------------------------------------------------------
QUERY_STOP = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "for", "of", "in", "on", "at", "to", "from", "by", "with", "and", "or", "but", "not", "that", "this", "these", "those", "what", "which", "who", "how", "why", "when", "where", "their", "there", "they", "than", "then", "so", "if")
RISK_TRIGGERS = ("risk", "risks", "barrier", "barriers", "challenge", "challenges", "uncertainty", "uncertain", "constraint", "constraints", "obstacle", "obstacles", "delay", "delays", "licens", "licensing", "regulatory", "regulation", "approval", "approvals", "cost", "costs", "economics", "haleu", "fuel", "financing", "schedule", "concern", "concerns", "problem", "problems", "difficulty", "issue", "issues")
RISK_VOCABULARY = ("risk", "risks", "barrier", "barriers", "challenge", "challenges", "uncertainty", "uncertain", "constraint", "constraints", "obstacle", "obstacles", "concern", "concerns", "licens", "regulat", "approval", "nrc", "certif", "permit", "haleu", "fuel", "supply chain", "manufacturing", "production", "availability", "shortage", "cost", "capital", "financ", "econom", "expensive", "investment", "foak", "first-of-a-kind", "affordab", "construction", "schedule", "delay", "timeline", "viab", "public acceptance", "limited", "lack", "insufficient", "unproven")

# -- evidence scoring (fixed values) --------------------------------------------------------------------------------------
QUESTION_STOP = ("about", "after", "also", "and", "are", "center", "data", "explain", "for", "from", "how", "implications", "into", "its", "the", "their", "this", "what", "with")
TOPICS = (
    ("architecture", ("architecture", "compute", "gpu", "cpu", "accelerator", "platform", "system")),
    ("power", ("power", "watt", "kilowatt", "kw", "megawatt", "mw", "distribution", "energy")),
    ("cooling", ("cool", "cooling", "thermal", "liquid", "heat")),
    ("networking", ("network", "networking", "ethernet", "infiniband", "nvlink", "switch")),
    ("rack architecture", ("rack architecture", "rack-scale", "rack", "nvl72", "mgx")),
)
CATEGORY_LADDER = (("rack architecture", TOPICS[4][1]), ("cooling", TOPICS[2][1]), ("networking", TOPICS[3][1]), ("power", TOPICS[1][1]), ("architecture", ("gpu", "cpu", "accelerator", "compute", "inference", "training")), ("rack architecture", ("rack", "nvl72", "system", "platform")))
CATEGORIES = ("architecture", "power", "cooling", "networking", "rack architecture", "operations", "gpu", "facility", "resiliency", "economics", "construction", "licensing", "reactor design", "grid integration", "fuel cycle", "deployment timeline", "safety", "waste management", "bwrx", "nuscale", "other")
CATEGORY_ALIASES = {"backup/resiliency": "resiliency", "backup": "resiliency", "resilience": "resiliency", "rack": "rack architecture", "reactor": "reactor design", "grid": "grid integration", "deployment": "deployment timeline", "fuel": "fuel cycle", "waste": "waste management", "nuclear safety": "safety", "design": "reactor design", "timeline": "deployment timeline", "integration": "grid integration"}
DOMAIN_TERMS = ("blackwell", "cooling", "cpu", "gpu", "inference", "networking", "nvidia", "nvl72", "power", "rack", "rubin", "thermal", "vera")
SPECIFIC_TERMS = ("bbu", "busway", "cabinet", "cdu", "chilled water", "connectx", "ethernet", "gb", "gpu", "hbm", "infiniband", "kw", "liquid", "mgx", "mw", "nvlink", "nvl72", "pdu", "rack", "spectrum", "switch", "thermal", "tray", "ups", "voltage", "watt")
SPECIFIC_NUMBER = r"\b\d+(?:\.\d+)?\s*(?:%|kw|mw|w|v|gb|tb|gb/s|tb/s)?\b"
UNIT_NUMBER = r"\b\d+(?:[.,]\d+)?\s*(?:%|kw|mw|gw|tw|w|kv|v|gb|tb|pb|gbps|tbps|hz|ghz|°c|kpa|bar|years?|months?|days?|hours?|mwe?|mwh|gwh|x|×)\b"
BARE_NUMBER = r"\b\d{2,}(?:[.,]\d{3})*\b"

# -- questions (fixed values) ---------------------------------------------------------------------------------------------
EXPLORATORY = ("factors", "factor", "barriers", "barrier", "challenges", "challenge", "implications", "implication", "trends", "trend", "landscape", "risks", "risk", "opportunities", "opportunity", "drivers", "driver", "overview", "summary", "analysis", "considerations", "consideration", "outlook", "prospects", "viability", "feasibility", "aspects", "aspect", "dimension", "dimensions", "issues", "issue", "concerns", "concern")
EXPLORATORY_PHRASE = r"(?i)\bwhat (?:are|were) (?:the )?(?:main |key |primary |major |top )"
QUESTION_MODES = (
    ("COMPARISON", r"(?i)\bcompare\b|\bvs\.?\b|\bversus\b|\bdifference[s]? between\b|\bcontrast\b|\bbetter than\b|\bworse than\b"),
    ("EXPLANATION", r"(?i)\bwhy\b|\bhow does\b|\bhow do\b|\bexplain\b|\bwhat causes?\b|\breason\b|\bmechanism\b|\bprinciple\b"),
    ("FACT_LOOKUP", r"(?i)\bhow many\b|\bhow much\b|\bwhat is the\b|\bwhat are the\b|\bhow (?:large|small|tall|wide|deep|heavy|fast|slow|efficient)\b|\bwhat (?:power|capacity|count|speed|bandwidth|weight|height|temperature|voltage|rating|limit|maximum|minimum|threshold)\b"),
)
ENTITY_LOCKS = (
    ("GB200 NVL72", ("NVL72", "nvl72")), ("GB200 NVL36", ("NVL36", "nvl36")), ("DGX B200", ("DGX B200", "dgx b200")), ("DGX H100", ("DGX H100", "dgx h100")), ("DGX H200", ("DGX H200", "dgx h200")), ("HGX H100", ("HGX H100", "hgx h100")),
    ("GB200", ("GB200", "gb200")), ("GB300", ("GB300", "gb300")), ("H100", ("H100", "h100")), ("H200", ("H200", "h200")), ("B200", ("B200 GPU", "b200 gpu")), ("A100", ("A100", "a100")), ("Blackwell", ("Blackwell", "blackwell")), ("Hopper", ("Hopper GPU", "hopper gpu")),
    ("BWRX-300", ("BWRX-300", "BWRX300", "bwrx-300", "bwrx300")), ("NuScale VOYGR", ("NuScale", "VOYGR", "nuscale", "voygr")), ("AP300", ("AP300", "ap300")), ("SMR-160", ("SMR-160", "smr-160")), ("NuwardSMR", ("Nuward", "nuward")),
)
METRIC_LOCKS = (
    ("gpu_count", r"(?i)\bhow many\s+(?:b200s?|gpus?|accelerators?)\b|\b(?:number|count)\s+of\s+(?:gpus?|accelerators?)\b|\bgpus?\s+(?:integrated|installed|in|per|count)\b"),
    ("rack_power", r"(?i)\brack\s+power\b|\bpower\s+(?:consumption|requirement|draw|demand|budget)\b|\btotal\s+power\b|\bhow\s+much\s+power\b|\bwatt[s]?\b|\bkilo?watt[s]?\b|\bkw\b"),
    ("cooling_capacity", r"(?i)\bcooling\s+(?:capacity|requirement|infrastructure)\b|\bwhy.+(?:liquid|water)\s+cool|\bhow\s+(?:is|does).+cool\b"),
    ("memory_capacity", r"(?i)\b(?:gpu\s+)?memory\s+(?:capacity|size|bandwidth|per)\b|\bhbm\b"),
    ("network_bandwidth", r"(?i)\bbandwidth\b|\bnvlink\b|\binfiniband\b"),
    ("lcoe", r"(?i)\blcoe\b|\blevelized\s+cost\b|\bcost\s+of\s+electricity\b"),
    ("construction_cost", r"(?i)\bconstruction\s+cost\b|\bcapital\s+cost\b|\bevernight\s+cost\b"),
    ("electric_output", r"(?i)\belectric(?:al)?\s+output\b|\bmwe\b|\bkwe\b|\bpower\s+output\b|\boutput\s+capacity\b"),
)

# -- prohibited terms (fixed values) ----------------------------------------------------------------------------------------
NEGATION = r"(?i)\b(no|not|cannot|can't|never|without|neither|nor|no\s+longer)\b"
EXEMPT = r"(?i)\b(eliminat\w*|replac\w*|remov\w*|supersed\w*|obsolet\w*|instead\s+of|rather\s+than|avoid\w*|prevent\w*|exceed\w*|surpass\w*|outperform\w*|faster\s+than|greater\s+than|higher\s+than|lower\s+than|beyond\s+what|legacy|conventional|traditional|predecessor\w*|previous\s+\w+\s+approach|used\s+to\s+rel|bottleneck|limitation|limited\s+to|constrain\w*|overhead|plagued|no\s+longer\s+need|not\s+via|not\s+using|not\s+required|not\s+necessar|mis-stat\w*|incorrect\w*|reduc\w+\s+\w+\s+overhead)"
CONTRASTIVE = r"(?i)\b(unlike|whereas|while|although|though|however|by\s+contrast|in\s+contrast|compared\s+to|versus|vs\.?|rather|contrast|nvl72|product\s+famil\w*|lineup|portfolio|sku|scaling\s+factor|different\s+config\w*|\d+\s*[-–]\s*\d+\s*months?|multi.?year\w*|several\s+years?|decade|years?\s+to\s+build|year\s+construction)\b"

# -- sources (fixed values) ---------------------------------------------------------------------------------------------------
SOURCE_QUALITY = (
    (("nvidia", "technical blog"), "nvidia_technical", 5), (("nvidia", "architecture"), "nvidia_technical", 5), (("nvidia", "specification"), "nvidia_technical", 5), (("nvidia", "spec"), "nvidia_technical", 5),
    (("nvidia", "platform"), "nvidia_technical", 5), (("nvidia", "blog"), "nvidia_technical", 5), (("inside the nvidia",), "nvidia_technical", 5), (("nvidia", "inside"), "nvidia_technical", 5), (("nvidia", "rubin"), "nvidia_technical", 5),
    (("nvidia", "blackwell"), "nvidia_technical", 5), (("nvidia", "nvl"), "nvidia_technical", 5), (("nvidia", "vera"), "nvidia_technical", 5), (("nvidia", "datasheet"), "nvidia_technical", 5), (("nvidia", "data sheet"), "nvidia_technical", 5),
    (("nvidia", "reference"), "nvidia_technical", 5), (("nvidia", "developer"), "nvidia_technical", 5), (("storagereview",), "independent_technical", 3), (("dissecting",), "independent_technical", 3), (("microbenchmark",), "independent_technical", 3),
    (("benchmarks",), "independent_technical", 3), (("nvidia",), "nvidia_marketing", 4), (("whitepaper",), "vendor_whitepaper", 4), (("white paper",), "vendor_whitepaper", 4), (("solution brief",), "vendor_brief", 4), (("solution_brief",), "vendor_brief", 4),
    (("press release",), "press_release", 4), (("analysis",), "independent_technical", 3), (("review",), "independent_technical", 3), (("blog",), "blog", 2), (("commentary",), "blog", 2), (("opinion",), "blog", 2), (("news",), "blog", 2),
    (("test_",), "synthetic", 1), (("_test.",), "synthetic", 1), (("synthetic",), "synthetic", 1), (("fixture",), "synthetic", 1),
)
SMR_SIGNALS = ("smr", "nuclear", "reactor", "bwrx", "nuscale", "nrc", "haleu", "moltex", "terrestrial", "kairos", "x-energy", "usnc", "cnsc", "thorcon", "newcleo", "holtec")
PERSPECTIVES_AI_DC = (
    ("power", ("power", "watt", "kw", "mw", "tdp", "thermal design power", "power consumption", "power draw", "energy", "pdu", "power delivery", "electrical", "ampere", "volt", "ups", "generator", "pue", "power usage effectiveness")),
    ("cooling", ("cool", "thermal", "heat", "temperature", "cdu", "liquid cooling", "air cooling", "immersion", "coolant", "btu", "hvac", "chiller", "rear door", "warm water", "direct liquid", "cold plate", "heat exchanger")),
    ("networking", ("network", "nvlink", "infiniband", "pcie", "bandwidth", "latency", "interconnect", "switch", "fabric", "rdma", "ethernet", "gb/s", "tb/s", "port", "topology", "nvl", "c2c", "chip-to-chip", "roce", "osfp")),
    ("operations", ("deploy", "install", "setup", "maintenance", "operate", "rack", "cabling", "floor", "management", "software", "driver", "firmware", "configuration", "lifecycle", "integration", "rollout", "skill", "staff")),
    ("economics", ("cost", "price", "price/performance", "tco", "roi", "dollar", "usd", "revenue", "efficiency", "$/", "investment", "capex", "opex", "value", "margin", "payback", "return", "profitability")),
    ("deployment", ("availability", "lead time", "ship", "quarter", "timeline", "schedule", "release", "launch", "product", "ramp", "roadmap", "ga", "general availability", "by 20", "planned", "next-generation")),
    ("supply_chain", ("supply", "manufacture", "wafer", "tsmc", "production", "chip", "fabrication", "shortage", "inventory", "foundry", "packaging", "memory", "hbm", "yield")),
)
PERSPECTIVES_SMR = (
    ("licensing", ("license", "nrc", "cnsc", "regulatory", "approval", "permit", "certification", "review", "iaea", "standard design", "design certification", "dc/col", "licensing process", "regulatory approval", "dcd")),
    ("construction", ("construct", "build", "concrete", "erect", "install", "timeline", "schedule", "first concrete", "commissioning", "modular", "fabricat", "assembly", "site preparation", "construction period", "build time", "years to build")),
    ("economics", ("cost", "capex", "lcoe", "financi", "dollar", "million", "billion", "price", "economics", "tco", "investment", "revenue", "overnight cost", "levelized", "capital cost", "project cost")),
    ("fuel", ("fuel", "uranium", "haleu", "enrichment", "fissile", "pellet", "rod", "assembly", "burnup", "cycle", "enriched", "u-235", "fuel cycle", "spent fuel", "fresh fuel", "refuel", "reload")),
    ("grid_integration", ("grid", "dispatch", "flexible", "load follow", "baseload", "peaking", "integration", "ancillary", "frequency", "capacity factor", "mwh", "mwe", "load following", "variable", "intermittent")),
    ("supply_chain", ("supply chain", "manufacture", "component", "vendor", "procurement", "forging", "pressure vessel", "shortage", "domestic", "international", "tier-1", "industrial base", "qualified supplier")),
    ("deployment", ("deploy", "site", "location", "commissioning", "first unit", "project", "contract", "mou", "loi", "commercial operation", "cod", "planned site")),
    ("public_acceptance", ("public", "community", "acceptance", "opposition", "sentiment", "opinion", "trust", "stakeholder", "local", "social licence", "consultation", "engagement", "perception", "support", "protest")),
)
CITATION = r"\[Source:\s*[^\]]*?Evidence:\s*(E\d{3,})[^\]]*\]"

# -- query plans (fixed values) --------------------------------------------------------------------------------
MODE_QUERIES = {"FACT_LOOKUP": (1, 3), "COMPARISON": (3, 5), "EXPLANATION": (3, 5), "EXPLORATORY_RESEARCH": (5, 8)}
METRIC_ANCHORS = {
    "gpu_count": ("{e} GPU count accelerators", "{e} 72 GPUs specifications", "{e} number of B200 GPUs"),
    "rack_power": ("{e} total rack power kW", "{e} power consumption requirements"),
    "cooling_capacity": ("{e} cooling requirements CDU", "{e} liquid cooling thermal"),
    "memory_capacity": ("{e} GPU memory HBM capacity", "{e} memory bandwidth specifications"),
    "network_bandwidth": ("{e} NVLink bandwidth fabric", "{e} interconnect bandwidth specifications"),
    "lcoe": ("{e} levelized cost electricity LCOE", "{e} construction cost economics"),
    "construction_cost": ("{e} construction capital cost overnight", "{e} cost schedule economics"),
    "electric_output": ("{e} electrical output capacity MWe", "{e} power generation specifications"),
}
GENERIC_ANCHORS = ("{e} specifications overview", "{e} design details")
TOPIC_EXPANSIONS = {
    "power": ("rack power consumption total load", "DC power infrastructure distribution", "power distribution unit PDU cooling", "UPS backup power capacity"),
    "cooling": ("liquid cooling direct liquid cooling DLC", "coolant distribution unit CDU capacity", "thermal management heat dissipation", "cooling infrastructure facility design"),
    "networking": ("NVLink switch fabric bandwidth", "InfiniBand networking topology", "network switch interconnect bandwidth latency"),
    "rack architecture": ("rack density form factor design", "compute tray shelf architecture layout", "rack unit U height configuration"),
    "operations": ("deployment commissioning operations", "data center monitoring observability", "maintenance schedule management"),
    "gpu": ("GPU memory bandwidth specifications", "GPU thermal design power TDP", "accelerator performance cluster"),
    "nvl72": ("NVL72 rack system architecture", "NVL72 power infrastructure shelf", "NVL72 liquid cooling design", "NVL72 NVLink switch configuration"),
    "gb200": ("GB200 NVL72 rack specifications", "GB200 power consumption infrastructure", "GB200 deployment design"),
    "facility": ("data center facility upgrade power", "raised floor power density design", "electrical infrastructure capacity"),
    "economics": ("SMR levelized cost electricity LCOE", "nuclear construction cost overrun", "FOAK first-of-a-kind cost premium", "NOAK nth-of-a-kind cost reduction", "economy of scale factory manufacturing", "nuclear financing interest rates overnight capital"),
    "construction": ("SMR construction duration schedule timeline", "modular construction factory fabrication", "construction risk contingency workforce", "civil works concrete steel cost"),
    "licensing": ("NRC design certification application", "nuclear regulatory approval process", "construction permit operating license", "SMR licensing pathway timeline risk"),
    "reactor design": ("SMR core design thermal output MWe", "passive safety system design", "reactor coolant loop pressure vessel"),
    "grid integration": ("grid flexibility load following baseload", "capacity factor ancillary services", "SMR dispatch flexibility hybrid energy"),
    "fuel cycle": ("uranium fuel enrichment supply chain", "HALEU high-assay low-enriched uranium", "fuel cost nuclear operations"),
    "deployment timeline": ("SMR commercial operation date commissioning", "deployment timeline first plant schedule"),
    "safety": ("passive safety shutdown decay heat", "containment design accident scenario"),
    "waste management": ("spent nuclear fuel storage disposal", "radioactive waste high-level repository"),
    "bwrx": ("BWRX-300 design specifications GE Hitachi", "BWRX-300 construction cost licensing"),
    "nuscale": ("NuScale SMR VOYGR design module", "NuScale licensing cost economics"),
}

# -- memo rules (fixed values): topics of a question, and the sections they require ------------------------------
QUESTION_TOPICS = (
    ("power", ("power", "electrical", "voltage", "utility", "grid", "ups", "bbu", "busway", "pdu")),
    ("cooling", ("cooling", "liquid", "thermal", "cdu", "heat", "chilled water")),
    ("networking", ("networking", "network", "nvlink", "infiniband", "ethernet", "spectrum", "connectx")),
    ("rack architecture", ("rack", "nvl72", "rack-scale", "tray", "shelf", "cabinet")),
    ("backup/resiliency", ("backup", "battery", "bbu", "ups", "resiliency", "redundancy")),
    ("operations", ("operations", "commissioning", "maintenance", "monitoring")),
)
TOPIC_SECTIONS = {"power": "power_implications", "cooling": "cooling_implications", "networking": "networking_implications", "rack architecture": "rack_architecture_implications"}
COVERAGE_WEIGHTS = {"strong": 1.0, "moderate": 0.6, "weak": 0.2, "none": 0.0}

# -- research plans and proxy scores (fixed values) ------------------------------------------------------------
SUBQUESTIONS = {
    "FACT_LOOKUP": ("What is the specific answer to: {q}", "What sources contain this information?", "Are there any caveats or conditions on this fact?"),
    "COMPARISON": ("What are the key dimensions for comparing in: {q}", "What are the strengths of each option?", "What are the limitations of each option?", "Which option is preferred under what conditions?"),
    "EXPLANATION": ("What is the mechanism behind: {q}", "What are the key contributing factors?", "What evidence supports this explanation?", "Are there alternative explanations?"),
    "RESEARCH": ("What are the key facts relevant to: {q}", "What evidence exists in the available sources?", "What are the main constraints or limitations?", "What are the practical implications?", "What gaps remain in the available evidence?"),
}
PROXY_EVIDENCE = r"(?i)\baccording\s+to\b|\bdata\s+shows?\b|\bevidence\s+suggests?\b|\bsource\b|\bcited\b|\breport\b|\bstudy\b|\banalysis\b"
PROXY_LOGIC = r"(?i)\bbecause\b|\bsince\b|\btherefore\b|\bthus\b|\bconsequently\b|\bhence\b"
PROXY_RISK = r"(?i)\brisk\b|\bchallenge\b|\bbarrier\b|\bconstraint\b|\bfail\b|\bhazard\b"

# -- decision records (fixed values) ---------------------------------------------------------------------------
STREAM_STOP = ("the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "with", "what", "which", "how", "is", "are", "be", "by", "at", "that", "this", "will", "can", "should", "do", "does", "within", "into", "from", "as")
RECORD_CAPS = {"themes": 8, "in_scope": 12, "success": 8, "unknowns": 6, "board": 6}
DECISION_VERBS = ("approve", "decide", "select", "authorize")
OBJECT_FIELDS = ("research_id", "question", "profile", "status", "created_at", "summary")
OBJECT_STATES = ("running", "completed", "failed")

# -- coverage rationale (fixed values) ------------------------------------------------------------------------
COVERAGE_NONE = "No evidence items found for '{topic}'."
COVERAGE_WEAK = "Weak evidence coverage. Only 1 evidence item found for '{topic}'."
COVERAGE_MORE = "{level} evidence coverage. {n} evidence items across {s} {word}."
#: from this mean quality on, or up to it
QUALITY_NOTES = ((4.5, "High-quality sources."), (4.0, "Good-quality sources."))
QUALITY_LOW = (1.5, "Low-quality sources only.")
GAPS_REMAIN = "Some research gaps remain regarding {gaps}."
