"""Fixed values of the signal types' rules: patterns by name, over lower-case texts.

All values here must be as they are for equal results. They are stated in the order in which rules came to need them. No pattern looks ahead or behind: where a
phrase is excluded, it is masked in the text first (``MASK``, for the patterns in ``MASKED``).
"""

from __future__ import annotations

#: Patterns shared by several rules.
SHARED: dict[str, str] = {
    "portfolio_update": r"\bportfolio\s+compan(?:y|ies)\b|\b(?:partecipata|controllata)\s+(?:da|di)\b|\btramite\s+(?:la\s+sua\s+)?(?:partecipata|controllata)\b|\bin\s+portafoglio\s+(?:a|di)\b|\bsociet[àa]\s+in\s+portafoglio\b|\badd[\-\s]?ons?\b|\bbolt[\-\s]?ons?\b|\btuck[\-\s]?ins?\b|\bcontrolling\s+shareholder\b",
    "exit_verbs": r"\bsells?\b|\bselling\b|\bsold\b|\bsale\b|\bexits?\b|\bexited\b|\bvend(?:e|ere|ita|ono)\b|\bvendut[oa]\b|\bcede\b|\bcession[ei]\b|\bdisinvest\w+\b|\bdivest\w+\b|\ba\s+vendere\b",
    "strong_exit_verbs": r"\bsells?\b|\bsold\b|\bvend(?:e|ere|ita|ono)\b|\bvendut[oa]\b|\bcede\b|\bcession[ei]\b|\bdisinvest\w+\b|\bdivest\w+\b|\bexits?\b|\bexited\b|\brealis(?:ation|ation|ed)\b|\brealiz(?:ation|ation|ed)\b|\bsale\s+of\s+(?:its?\s+)?(?:stake|shares?|interest|partecipazione|quota)\b|\bsuccessful\s+realis\w+\b",
    "invest_verbs": r"\binveste\b|\binvestono\b|\bacquir\w+\b|\bacquisizion\w*\b|\brileva\b|\binvest(?:s|ing)?\s+(?:in|into|nel|nella|nei|nelle)\b|\binvestiment[oi]\s+(?:di|da|in|nel|per)\b|\bprende\s+il\s+controllo\b|\bingresso\s+(?:di|in|nel)\b|\bentra\s+nel\s+capitale\b|\boperazion[ei]\s+di\s+(?:debito|credito)\b|\binvestitore\s+unic\w*\s+al\s+fianco\s+di\b|\bsole\s+investor\s+(?:backing|alongside)\b|\btakes?\s+(?:a\s+)?(?:stake|quota|partecipazione)\b|\bpreso\s+(?:una?\s+)?(?:quota|partecipazione)\b|\binvested\s+in\b|(?:^|\W)[€$£]\s*[\d.,]+[MBK]?\s+in\s+investments?\b",
    "board_appoint": r"\b(?:board|consiglio|nomin(?:a|at\w+|e)|appointed|eletto|responsabile|nuovo\s+(?:cda|consiglio))\b",
    "ordinal_investment": r"\b(?:nuovo|nuov[oa]|primo|secondo|terz[oa]|quart[oa]|quint[oa]|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d+[°ºª]?(?:st|nd|rd|th)?)\s+(?:investiment[oi]|operazione|investment|deal|operation)\b",
    "chiude_raccolta": r"\bchiude\s+la\s+raccolta\b|\bchiude\b.*\bfundraising\b|\bcloses\s+fundraising\b",
    "fundraise_closing": r"\bchius[oa]\b.*\bclosing\b|\bclosing\b.*\bchius[oa]\b|\bchiude\b.*\bclosing\b|\bchiuso il closing\b|\bfinal close\b|\bhard cap\b|\bclosing\s+(?:del|di|per|of)\s+(?:il\s+)?(?:fondo|fund|veicolo|oversubscribed)\b|\b(?:primo|secondo|terzo|first|second|third|successful)\s+(?:fundraising\s+|fundraise\s+)?clos(?:e|ing)\b|\breach\w*\s+(?:its\s+)?(?:first|second|third|final)\s+(?:fundraising\s+|fundraise\s+)?clos(?:e|ing)\b|\brealizza\b.*\bclosing\b|\b(?:announces?|completes?|closes?)\s+(?:its?\s+)?(?:first|second|final)\s+(?:fundraising\s+)?clos(?:e|ing)\b",
    "fundraise_milestone": r"\bsupera\s+(?:i\s+)?\d+.*(?:raccolt|capital)\b|\bsupera(?:ndo)?\s+(?:il\s+)?(?:proprio\s+)?target\b|\bsurpass\w*\s+\d+.*(?:raised|capital)\b|\bsurpass(?:ing)?\s+(?:its?\s+)?target\b|\barriva\s+a\s+\d+.*\b(?:m|mln|milion)\b",
    "outsourcing": r"\b(?:outsourcing|affidamento\s+in\s+outsourcing|indagine\s+esplorativa|manifestazion[ei]\s+di\s+interesse|procedura\s+comparativa|gara\s+d[i'\u2019]\s*appalto|bando\s+di\s+gara|soliciting\s+expressions?\s+of\s+interest|full[\-\s]?outsourcing\s+provider|request\s+for\s+(?:proposal|quote|information)s?|RFP\s+for\b)\b",
    "fashion_campaign": r"\b(?:spring[\s/]+summer|fall[\s/]+winter|autumn[\s/]+winter|SS\s*\d{2,4}|FW\s*\d{2,4}|AW\s*\d{2,4})\b.*\b(?:campaign|collection|lookbook|runway|fashion\s+show|capsule)\b|\b(?:campaign|collection|lookbook|runway|fashion\s+show|capsule)\b.*\b(?:spring[\s/]+summer|fall[\s/]+winter|autumn[\s/]+winter|SS\s*\d{2,4}|FW\s*\d{2,4}|AW\s*\d{2,4})\b|\b(?:shot\s+on\b|directed\s+by\b|photographed\s+by\b|creative\s+director\b).*\b(?:campaign|collection)\b|\bpresents?\s+(?:its?\s+)?(?:new\s+)?(?:spring|fall|winter|summer|SS|FW|AW)\b|\bchooses?\s+(?:the\s+)?\w.*?\bfor\s+(?:its?\s+)?.*?\bcampaign\b|\bselects?\s+(?:the\s+)?\w.*?\bfor\s+(?:its?\s+)?.*?\bcampaign\b",
    "boilerplate_template": r"^new\s+(?:investment|deal|fundraise)\s+involving\s+[\w\s]+$|^new\s+(?:investment|deal)\s+in\s+[\w\s]+$|^the\s+messenger$",
    "editorial_format": r"\b(?:shift|switch|transition)\w*\s+(?:from|to)\s+(?:weekly|fortnightly|monthly|biweekly|daily)\b|\b(?:weekly|fortnightly|monthly|biweekly)\s+(?:to|issues?)\b.*\b(?:premium|positioning|format)\b|\b(?:editorial|magazine)\s+(?:format|strategy|relaunch|rebrand)\b",
    "job_selection": r"\b(?:procedura\s+di\s+selezione|ricerca\s+(?:una?\s+)?risors[ae]|selezione\s+per\s+(?:il\s+)?(?:ruolo|responsabile|posizione)|avvia\s+(?:la\s+)?selezione)\b",
    "report": r"\b(?:bilancio|financial\s+results?|annual\s+report|year[\-\s]?end\s+report|financial\s+plan|piano\s+economico\s+finanziario|strategic\s+plan|piano\s+strategico|sustainability\s+report|rapporto\s+(?:annuale|di\s+sostenibilit[àa])|esg\s+report|quarterly\s+(?:report|credit\s+check|results?)|interim\s+report|half[\-\s]?year\s+report|utile\s+d[i'\u2019]\s*esercizio|closes?\s+(?:the\s+)?financial\s+year|risultati?\s+finanziari|(?:primo|secondo|terzo|quarto)\s+trimestre\b.*\butile\b|utile\s+netto\s+a\s+\d+|\bnet\s+profit\b|\butile\s+netto\b|\bcompletes?\s+turnaround\b|\bended?\s+\d{4}\s+with\s+(?:a\s+|an\s+)?(?:profit|loss|net\s+income|ebitda|gain)\b|\bnav\s+per\s+(?:share|unit|quota)\b|\bvolumes?\s+(?:up|down|grew|declined)\b.{0,40}\b(?:profit|utile|revenue|ricavi)\b|\b(?:profit|utile)\b.{0,40}\b(?:volumes?\s+(?:up|down|grew)|revenue|ricavi)\b|\b(?:global|annual|yearly|sector)\s+review\s+of\s+(?:m&a|mergers?|acquisitions?|deals?)\b|\bm&a\s+(?:review|roundup|overview|report|barometer|landscape)\b|\bbilan\s+(?:mondial|annuel|semestriel)\s+des\s+(?:f[&\s]a|fusions?|acquisitions?)\b|\bannual\s+(?:m&a|deal|transaction)\s+(?:review|report|summary|overview)\b)\b",
    "mgmt_company_financials": r"\bvolumes?\s+(?:up|down|grew|declined)\b.{0,60}\b(?:profit|utile)\b|\b(?:profit|utile)\b.{0,60}\bvolumes?\s+(?:up|down|grew|declined)\b|\b(?:primo|secondo|terzo|quarto)\s+(?:trimestre|quarter)\b.{0,80}\butile\s+netto\b|\butile\s+netto\b.{0,80}\b(?:primo|secondo|terzo|quarto)\s+(?:trimestre|quarter)\b|\b(?:primo|secondo)\s+semestre\b.{0,80}\butile\s+netto\b|\butile\s+netto\b.{0,80}\b(?:primo|secondo)\s+semestre\b|\butile\s+netto\b.{0,80}\b(?:superio\w+|oltre|exceed\w*)\b",
    "event_attendance": r"\b(?:guest|relator[ei]|speaker|panelist|moderator)\b.*\b(?:event[oi]?|congress[oi]?|summit|conferenz\w*|forum|webinar|panel|convegno)\b|\b(?:event[oi]?|congress[oi]?|summit|conferenz\w*|forum|webinar|panel|convegno)\b.*\b(?:guest|relator[ei]|speaker|panelist|moderator)\b|\binterviene\s+(?:a|al)l['\u2019]?\s*(?:event[oi]?|congress[oi]?|summit|conferenz\w*|forum|webinar|panel)\b|\b(?:partecipa|interviene|presente)\s+(?:a|al)l['\u2019]?\s*\w+\s*(?:event[oi]?|congress[oi]?|summit|conferenz\w*|forum|webinar|panel|convegno)\b|\bspeaks?\s+at\s+(?:the\s+)?(?:event|conference|summit|forum|congress|panel|webinar|convegno)\b|\bcontribut\w+\s+(?:to|a|al)l?\b.{0,60}\b(?:event[oi]?|congress[oi]?|summit|conferenz\w*|forum|convegno)\b",
    "event_title": r"^(?:.*\s)?(?:congress[oi]?|summit|forum|conferenz\w*|convegno|workshop|webinar|tavola\s+rotonda|seminari[oi]?)\s*(?:\d{4}|in\s+\w+|$)",
    "event_insights": r"\binsights?\s+from\b.*\b(?:conference|summit|forum|event)\b|\b(?:conference|summit|forum)\s+(?:recap|highlights?|takeaways?|wrap[\-\s]?up)\b",
    "joins_event": r"\b(?:joins?|partecipa|presente)\s+(?:a\s+|al\s+|strategic\s+|the\s+)?\w*\s*(?:forum|congress[oi]?|summit|conferenz\w*|convegno|event)\b",
    "explicit_seller": r"\ba\s+vendere\b|\bil\s+venditore\b|\bcede\s+(?:la\s+)?(?:propria\s+)?(?:partecipat\w+|quota|partecipazione)\b|\bcede\s+(?:il\s+)?(?:proprio\s+)?(?:\d+%|controllo|majority|maggioranza)\b|\bdisinvestiment[oi]\b",
    "partnership": r"\bpartnership\b|\bpartners?\s+with\b|\bjoint\s+venture\b|\bdistribution\s+agreement\b|\bstrategic\s+alliance\b|\bcollaborazione\s+strategica\b|\baccordo\s+(?:di\s+)?(?:collaborazione|distribuzione|partnership)\b|\balleanza\s+strategica\b|\bintesa\s+(?:strategica|commerciale)\b|\bjoins?\s+forces\b|\bjoined\s+forces\b",
    "partnership_exclude": r"\bacqui\w+\b|\brileva\b|\bbuyout\b|\bmajority\b|\bminority\s+stake\b|\bentra\s+nel\s+capitale\b",
    "finalizzat": r"\bfinalizzat\w+\b",
    "research": r"\b(?:white\s*paper|report\s+(?:annuale|di\s+ricerca)|ricerca|studio|analisi|survey|outlook|barometr\w+|osservatori\w+)\b",
    "investor_meeting": r"\binvestor\s+(?:meeting|day|event|conference)\b|\bassemblea\s+(?:dei\s+)?(?:soci|azionisti|investitori)\b|\bagm\b|\bannual\s+general\s+meeting\b",
    "exited_from_portfolio": r"\b(?:exited?\s+from\s+.*portfolio|uscit[ao]\s+dal?\s+portafoglio)\b",
    "bond_issuance": r"\b(?:bonds?|obbligazion\w+|emissione|rifinanzia\w+|refinanc\w+|debt\s+issuance|collocamento|collocare?|minibond[s]?|mini\s+bond[s]?|basket\s+bond[s]?)\b",
    "bond_exclude": r"\b(?:acqui\w+|rileva|investiment[oi]|exit|sells?|cessione|launch|lancia|nasce|aucap|aumento\s+di\s+capitale)\b",
    "debt_financing_broad": r"\bprivate\s+debt\s+(?:transaction|deal|operazion\w+|investiment\w+)\b|\bprivate\s+debt\b.*\b(?:completes?|conclude|chiude|finalizzat\w+)\b|\bottiene\s+(?:da\s+\w+\s+)?finanziament[oi]\b|\bfinanziament[oi]\s+(?:per|da|di)\s+[€$£]?\s*[\d.,]+\s*(?:m\b|mln|milion)|\b(?:€|\$|£)?\s*[\d.,]+\s*(?:m\b|mln|million|milion|bn|billion)\s+in\s+new\s+financing\b|\bsecuritiz\w+\b|\bcartolarizzazion\w+\b|\bnuov[aoe]\s+(?:operazion[ei]\s+di\s+)?(?:debito|finanziament[oi])\b|\bgreen\s+bond\b|\bdebt\s+(?:operation|transaction|facility)\b|\boperazion[ei]\s+di\s+debito\b|\bsenior\s+(?:secured\s+)?(?:loan|debt|facility|notes?)\b|\bmezzanine\s+(?:financ\w+|debt|loan)\b|\bunitranche\b|\bprovid(?:es?|ed|ing)\b.{0,30}\bfinanc(?:ing|e)\b|\bfinancing\s+support\b|\breceives?\s+financ(?:ing|e)\s+from\b|\bsecures?\b.{0,40}\b(?:loan|prestito)\b",
    "credit_facility": r"\brevolving\s+credit\s+facilit\w+\b|\bcredit\s+facilit\w+\b.*\b(?:upsize|extend|renew)\b|\b(?:upsize|extend)\w*\b.*\bcredit\s+facilit\w+\b",
    "project_financing": r"\bproject\s+financing\b|\briceve\s+finanziamento\b|\bottiene\s+(?:da\s+)?\w+\s+finanziamento\b|\bsottoscritto\s+(?:project\s+)?financ\w+\b",
    "has_any_pe_verb": r"\b(?:sells?|selling|sold|sale|exit\w*|cessione|vendita|vend[eio]\w*|vendut[oa]|cedut[oa]|dismette|a\s+vendere|acquir\w+|acquisizion\w*|investi\w+|rileva|entra\s+nel\s+capitale|enters?\s+capital|buys?|compra|offerta\b|offer\b|bid\b|fundrais\w+|raccolta|closing|round|series|seed|chiude|chiusura|launch|lancia|nasce|nascita|lancio|partnership|joint\s+venture|nomina|appointed|ipo\b|merger|fusione|buyout|lbo\b|takeover|finanziamento|aumento\s+di\s+capitale|operazione|finalizzat\w+)\b",
    "accelerator_launch": r"\b(?:lancia|lancio|nasce|nascita|launch(?:es|ed)?|avvia|al\s+via)\b.*\b(?:accelerator(?:e)?|incubator(?:e)?|polo|programma|program|hub)\b|\b(?:accelerator(?:e)?|incubator(?:e)?|polo|programma|program|hub)\b.*\b(?:lancia|lancio|nasce|nascita|launch(?:es|ed)?|avvia|al\s+via)\b",
    "fund_launch_strict": r"\b(?:lancia|lancio|nasce|nascita|launch(?:es|ed)?|avvia|al\s+via)\b.{0,80}\b(?:fondo|fund|comparto|veicolo|vehicle)\b|\b(?:fund|fondo)\s+(?:i{1,3}|iv|v|vi{1,3}|ix|x|\d+)\b|\bnew\s+fund\b|\bnuovo\s+fondo\b|\bfund\s+formation\b|\bvehicle\s+launch\b|\bfund\s+(?:launch|inception|creation)\b|\bcomparto\b.{0,50}\b(?:operativo|attivo|avviato)\b|\boperativ[oa]\s+(?:il\s+)?comparto\b",
    "company_round": r"\b(?:round|serie|series|seed|pre[-\s]?seed)\s+(?:a|b|c|d|e|f|di)\b|\bserie\s+[a-f]\b|\bround\s+(?:seed|pre[-\s]?seed)\b|\bround\s+(?:d[i'\u2019]\s*)?(?:investimento|finanziamento)\b|\bround\s+da\s+[€$£]?\s*[\d.,]+|\bincassa\s+(?:nuovo\s+)?round\b|\braccog\w+\s+[€$£]?\s*[\d.,]+\s*(?:m\b|mln|milion|k\b|mila)|\baumento\s+di\s+capitale\b.*\bstartup\b|\bstartup\b.*\baumento\s+di\s+capitale\b|\bchiude\s+un\s+(?:round|aumento\s+di\s+capitale)\b|\briceve\s+un\s+finanziamento\b|\baumento\s+di\s+capitale\s+(?:con|sottoscritto\s+da|da)\s+\w+|\b(?:startup|scaleup|scale-up|spin[\-\s]?off)\b.*\b(?:chiude|raccog\w+|riceve|incassa|ottiene|conclude|completa)\b|\b(?:chiude|raccog\w+|riceve|incassa|ottiene|conclude|completa)\b.*\b(?:startup|scaleup|scale-up|spin[\-\s]?off)\b|\bfinanziamento\s+da\s+[€$£]?\s*[\d.,]+|\bottiene\s+un\s+finanziamento\b|\b(?:completa|conclude)\s+(?:un\s+)?(?:round|aumento\s+di\s+capitale)\b|\bporta\s+a\s+casa\s+(?:un\s+)?round\b|\b(?:chiuso|completato|concluso)\s+(?:il\s+)?(?:round|aumento\s+di\s+capitale)\b|\braccog\w+\s+(?:oltre\s+)?[€$£]\s*[\d.,]+\b|\bround\s+(?:aggiuntivo|addizionale)\b|\bincassa\s+(?:altri\s+)?[€$£]?\s*[\d.,]+\s*(?:m\b|mln|milion|k\b|mila)|\b\d+(?:[.,]\d+)?\s*(?:milion\w*|mln|mila)\s+di\s+euro\s+di\s+raccolta\b|\bpassa\s+a\s+(?:fondo|fund)\b|\b(?:closed?s?|completes?|secures?|raises?)\s+(?:a\s+)?[€$£]?\s*[\d.,]+\s*(?:M|m|mln|million|B|bn|billion)?\s*(?:round|funding)\b|\b[€$£]\s*[\d.,]+\s*(?:M|m|mln|million|B|bn|billion)\s+(?:round|funding)\s+(?:led|backed|from)\b|\bstartup\b.*\b(?:closed?s?|raised?s?|secures?|completes?)\b.*\b(?:round|funding)\b|\b(?:closed?s?|raised?s?|secures?|completes?)\b.*\b(?:round|funding)\b.*\bstartup\b",
    "lp_commitment": r"\b(?:entra|aderisce|sottoscrive)\s+(?:nel|al|il)\s+(?:fondo|fund)\b|\b(?:nuov[oi]\s+)?(?:sottoscrittore|investitore|LP)\s+(?:del|nel|per)\s+(?:il\s+)?(?:fondo|fund)\b",
    "fund_level_fundraise": r"\b(?:primo|secondo|terzo|final[e]?)\s+closing\s+(?:del|di|per)\s+(?:il\s+)?(?:fondo|fund|veicolo)\b|\bclosing\s+(?:del|di|per|of)\s+(?:il\s+)?(?:fondo|fund|veicolo)\b|\btarget\s+size\b|\bhard\s+cap\b|\braccolta\s+(?:del|di|per)\s+(?:il\s+)?(?:fondo|fund)\b|\braccog\w+.*\b(?:per|for)\s+(?:il\s+proprio\s+|its?\s+own\s+)?(?:fondo|fund)\b|\bchiude\s+la\s+raccolta\s+(?:del|di|per|d[i'\u2019])\b|\bfirst\s+closing\s+(?:for|of|per)\b|\bcommitted?\s+capital\b|\bfund\s+(?:i{1,3}|iv|v|vi{1,3}|ix|x|\d+)\s+(?:at|a|di)\s+|\boversubscribed\b|\bfondo\s+di\s+(?:continuazione|debito|private\s+debt)\b|\bsurpass\w+\s+.*?\bin\s+raised\s+capital\b|\bsupera\s+.*?\bin\s+capitale\s+raccolto\b",
    "debt_restructuring": r"\baccordo\s+(?:tra|con)\s+(?:il\s+)?(?:i\s+)?creditor\w*\b|\baccordo\s+di\s+ristrutturazione\b|\bconcordato\b|\brestructuring\s+agreement\b|\bcomposition\s+with\s+creditors?\b|\badministrative\s+liquidation\b|\brestructuring\s+of\s+(?:approximately\s+)?[€$£]",
    "people_title": r"\bappoint\w+|\bjoins?\b|\bpromot\w+\b|\bnamed\b|\bnew\s+(?:ceo|cfo|coo|cio|partner)\b|\bleaves?\b|\bleaving\b|\bleft\b|\bresign\w*\b|\bsteps?\s+down\b|\bstepping\s+down\b|\bdepart\w*\b|\bdimission\w*\b|\blascia\b|\blasciat\w+\b|\babbandona\b",
    "chiude_fondo": r"\bchiude\s+la\s+raccolta\b|\bchiude\b.*\bfundraising\b|\bcloses\s+fundraising\b|\bchiude\b.*\b(?:fondo|fund)\b|\bchiusura\b.*\b(?:fondo|fund)\b",
    "value_creation": r"\bvalue\s+creation\s+(?:driver|lever|tool|approach)\b",
    "event_recap_italian": r"\bpartner\s+coinvolti\b|\bstartup\s+accelerat\w+\b|\brete\s+nazionale\s+accelerator\w+\b",
    "interview": r"\bintervist\w+\b|\binterview\w*\b|\bevoluzione\s+editoriale\b|\bda\s+settimanale\s+a\b|\bprofile\s+of\b|\bportrait\s+of\b|\bsat\s+down\s+with\b|\bsits?\s+down\s+with\b",
    "revenue_performance": r"\bricavi\s+(?:ricorrenti|netti|totali)\b|\brevenue\s+(?:of|growth|reached|exceeds)\b|\braggiunge\s+(?:ricavi|fatturato|vendite)\b|\bfatturato\s+(?:di|pari|a)\b|\bebitda\s+shortfall\b|\bchiude\s+(?:la\s+)?settimana\s+in\s+(?:calo|rialzo)\b|\bal\s+nasdaq\b.*\btitolo\b",
    "offer_bid": r"\bofferta\s+(?:da|di|per)\s+\d+|\boffer\s+(?:for|of|to\s+acquire)\b|\boffer(?:s|ed|ing)?\s+[€$£]?\s*\d+|\bbid\s+(?:for|of|to\s+acquire)\b|\bofferta\s+(?:vincolante|non\s+vincolante|di\s+acquisto)\b",
    "office_opening": r"\bopens?\s+(?:a\s+|an\s+|new\s+)?(?:\w+\s+){0,3}office\b|\bapre\s+(?:un\s+)?(?:nuovo\s+)?ufficio\b",
    "editorial_strategy": r"\binvestment\s+(?:strategy|approach|philosophy|thesis|era|landscape)\b|\bstrategia\s+d[i'\u2019]\s*investiment[oi]\b|\bour\s+(?:approach|strategy|investment\s+process)\b|\binvestire\s+in\s+(?:innovazione|crescita|sviluppo|futuro|sostenibilit\w+)\b|\b(?:key\s+player|game\s+changer|new\s+era|outlook|perspectives?|trends?)\s+(?:in|for|of)\s+(?:the\s+)?(?:\w+\s+)?(?:investment|market|sector|industry)\b",
    "accelerator_results": r"\b(?:risultati|graduates?|selezionat[ei]|completat[oi]|conclus[oi]|demo\s*day|batch)\b.*\b(?:accelerat\w+|programma)\b|\b(?:accelerat\w+|programma)\b.*\b(?:risultati|graduates?|selezionat[ei]|completat[oi]|conclus[oi]|demo\s*day|batch)\b",
    "fund_launch_verbs": r"\b(?:launch(?:es|ed)?|lancia|nasce|nascita|lancio)\b.*\b(?:fund|fondo)\b",
    "launch_fund": r"\b(?:launch(?:es|ed)?|lancia|nasce|nascita|lancio|avvia|al\s+via)\b.{0,80}\b(?:fund|fondo|comparto|veicolo|vehicle)\b",
    "regulatory_communication": r"\binternal\s+dealing\b|\bcomunicazione\s+(?:internal|interna)\b|\bcomunicazione\s+internal\s+dealing\b|\bsoggetto\s+rilevante\s+mar\b|\bregulatory\s+(?:filing|notice|communication)\b|\bandamento\s+(?:titolo|in\s+borsa)\b|\bprocedura\s+di\s+adempimento\b|\blake\s+bidco\b",
    "acquisition_verbs": r"\b(?:acquir\w+|acquis\w+|acquisizion\w+|investi\w+|rileva|entra\s+(?:nel\s+capitale|in)\b|enters?\s+capital|buys?|compra|tratt[ai]\s+l[''\u2019]acquisto)\b",
    "internship": r"\b(?:offerta\s+di\s+stage|tirocini[oa]?|stage\s+curriculare)\b",
    "job_posting_reclassify": r"\b(?:procedura\s+di\s+selezione|ricerca\s+(?:una?\s+)?risors[ae]|selezione\s+per\s+(?:il\s+)?(?:ruolo|responsabile|posizione)|avvia\s+(?:la\s+)?selezione|seeks?\s+a\s+(?:full|part)[\-\s]time)\b",
    "fundraise_closed_verbs": r"\bfinal close\b|\bhard cap\b|\bclos(?:es|ed)\b|\bchiude\b|\bchius[oa]\b|\bcomplet\w+\b|\bclosing\s+(?:del|di|per|of)\s+(?:il\s+)?(?:fondo|fund|veicolo|oversubscribed)\b|\b(?:primo|secondo|terzo|first|second|third|final|successful)\s+clos(?:e|ing)\b",
    "fundraise_verbs_full": r"\bfirst close\b|\bfinal close\b|\bhard cap\b|\bclosed\b|\bclosing\b|\bfundrais\w+\b|\braccolta\b|\bchiude\b|\bchiusura\b|\braccog\w+\b",
    "fundraise_acquisition": r"\brileva\b|\bentra (?:nel capitale|in)\b|\bacquisizion\w*\b|\bacquisisce\b|\bacquir\w+\b|\bcompra\b",
    "debt_restructure_context": r"\b(?:debt|debito|creditor\w*|creditor[ei]|scadenza\s+del\s+debito|maturity)\b",
    "close_verbs": r"\bchiude\b|\bcompleta\b|\bchiusura\b|\bclosed?\b|\bclosing\b",
    "round_invest": r"\bround\s+(?:d[i'\u2019]\s*)?(?:investimento|finanziamento|pre[\-\s]?seed|seed|serie)",
    "strong_deal": r"\bacquis\w+|\bcompra\b|\brileva\b|\bentra\s+nel\s+capitale\b|\binvest(?:s|ed|ing)?\s+(?:in|nel)\b|\bround\b|\bseries\s+[a-f]\b|\bfinanziament[oi]\b|\baumento\s+di\s+capitale\b|\bfundrais\w+\b|\bsecures?\s+(?:€|\$|£)?\s*[\d.,]+\s*(?:m\b|mln|million|milion|k\b|bn|billion)?\s*(?:investment|funding|financing)?\b|\bsecur(?:es?|ing)\b.{0,40}\b(?:investment|funding|financing)\b|\binvestitore\s+unic\w*\s+al\s+fianco\s+di\b|\bsole\s+investor\s+(?:backing|alongside)\b",
    "team_strengthening": r"\b(?:rafforzamento|potenziamento|ampliamento)\s+(?:del\s+)?(?:team|staff|organico|management)\b|\bstrengthens?\b.*\bteam\b|\bsenior\s+appointments?\b|\bseries\s+of\s+(?:senior\s+)?appointments?\b",
    "buyer_cues": r"\bin\s+lizza\b|\bpotrebbe\s+essere\s+interessat\w*\b|\bpotrebbero\s+essere\s+interessat\w*\b|\bvaluta\s+l['\u2019]acqui\w+\b",
    "merger": r"\b(?:fusion[ei]|merger|merg(?:e|es|ed|ing)|fonde|si\s+fondono)\b",
    "agreement": r"\b(?:agreement|accordo|intesa|convenzione)\b",
    "agreement_partnership_context": r"\b(?:partnership|collaborazione|gestione|manage|management|tenders?|bando)\b",
    "advisory_board": r"\b(?:advisory\s+board|comitato\s+(?:scientifico|consultivo))\b",
    "fund_compartment_operational": r"\boperativ[oa]\s+(?:il\s+)?comparto\b|\bcomparto\b.*\boperativ[oa]\b",
    "closing_fund": r"\bclosing\s+(?:del|di|per|of)\s+(?:il\s+)?(?:fondo|fund|oversubscribed)\b",
    "portfolio_company_backed": r"\b(?:partecipata|sostenuta|backed)\b.*\b(?:acquis\w+|acquir\w+|complet\w+|espand\w+|expand\w+|rafforz\w+)",
    "portfolio_expansion": r"\b(?:strengthens?|expand(?:s|ed|ing)?|continues?\s+(?:its\s+)?(?:development|expansion)|pursues?\s+(?:its\s+)?expansion)\b.{0,40}\b(?:foothold|footprint|presence|coverage|development|expansion)\b",
    "portfolio_co_as_acquirer": r"\b\w+[\-\u2010\u2011\u2012\u2013](?:backed|owned|controlled)\b\s+\w.{0,100}\b(?:acquir\w+|merg\w+|purchas\w+)\b|\bbacked\s+by\b.{0,120}\b(?:acquir\w+|merg\w+|purchas\w+)\b|\bportfolio\s+compan(?:y|ies)\b.{0,120}\b(?:acquir\w+|merg\w+)\b|\b(?:partecipata|sostenuta|controllata)\s+(?:da|di|by)\b.{0,120}\b(?:acquir\w+|acquis\w+|merg\w+)\b|\btramite\s+(?:la\s+sua\s+)?(?:partecipata|controllata)\b.{0,120}\b(?:acquir\w+|acquis\w+)\b|\b(?:promoted|controllat[oa]|promoss[oa]|controlled)\s+(?:by|da)\b.{0,120}\b(?:acquir\w+|espand\w+|expand\w+|merg\w+)\b|\b(?:add[\-\s]?on|bolt[\-\s]?on|tuck[\-\s]?in)\s+(?:acqui\w+|deal|investment|operazion\w+)\b|\b(?:acqui\w+|deal)\b.{0,30}\b(?:add[\-\s]?on|bolt[\-\s]?on|tuck[\-\s]?in)\b|\b\w[\w\s.,'-]{2,50}\s+\([A-Za-z][^)]{2,59}\)\s*.{0,60}\b(?:acquir\w+|acquis\w+|merg\w+)\b",
    "interview_editorial": r"\bintervist\w+\b|\binterview\w*\b|\bsat\s+down\s+with\b|\bsits?\s+down\s+with\b|\breflects?\s+on\b|\bexplains?\b|\bspiega\b|\bracconta\b|\bin.depth\s+look\b|\banalysis\s+of\b",
    "people_language": r"\b(?:nomin\w+|hired?|joins?|joined|promot\w+|assume\s+(?:il\s+)?(?:ruolo|incarico)|entra\s+(?:nel\s+)?(?:team|consiglio|cda)|nuovo\s+(?:ingresso|membro)|new\s+(?:team\s+)?member|steps?\s+down|stepping\s+down|leaves?|leaving|left\s+(?:the\s+)?(?:firm|fund|company|role)|resign\w*|depart\w*|dimission\w*|lascia|lasciat\w+|abbandona|succession\w*|succeed\w*|replac\w+|names?\s+\w[\w\s]{1,40}\s+as\s+(?:(?:new|incoming|interim|acting)\s+)?(?:head|chief|director|managing\s+director|partner|president|vice|senior)|appoints?\s+\w[\w\s]{1,40}\s+as\s+(?:(?:new|incoming|interim|acting)\s+)?(?:head|chief|director|managing\s+director|partner|president|vice|senior)|appointed\s+(?:as\s+)?(?:(?:new|incoming|interim|acting)\s+)?(?:head|chief|director|managing\s+director|partner|president|vice|senior))\b",
    "appointment_verbs": r"\b(?:appoint\w+|nomin\w+|joins?|entra)\b",
    "people_appointment_rescue": r"\b(?:names?|appoints?|appointed|hired?)\b.*\b(?:head|director|partner|managing|chief|ceo|cfo|coo|cto|president|chairman)\b",
    "team_profile_noise": r"^[a-zà-öø-ÿ][a-zà-öø-ÿ''.\-]+(?:\s+[a-zà-öø-ÿ][a-zà-öø-ÿ''.\-]+){1,3}\s+(?:(?:managing|senior|junior|lead|principal|chief)\s+)?(?:head|director|manager|partner|officer|counsel|analyst|associate|specialist|investor\s+relations|legal\s*(?:&|and)\s*corporate\s+affairs(?:\s+(?:specialist|manager|head|director))?)\b",
    "role_opening_title": r"^\s*(?:senior|junior|lead|principal|chief|head|managing)?\s*(?:investment\s+)?(?:associate|analyst|manager|specialist|advisor|officer|counsel|director)\b",
    "strategic_plan_presentation": r"\bpresent\w*\s+(?:its|the|new|a|an)?\s*(?:\d{4}\s*[-–—]\s*\d{4}\s+)?(?:strategic\s+plan|piano\s+strategico|business\s+plan|piano\s+industriale)\b",
    "committee_establishment": r"\bestablish\w+\s+(?:a\s+|an\s+|the\s+)?(?:committee|comitato|advisory\s+board|investment\s+committee|board\s+of\s+advisors)\b",
    "management_roundup": r"\b(?:management|executive|leadership|people|c-suite)\s+shuffles?\b|\b(?:management\s+shake[\-\s]?up|management\s+changes\s+this\s+week)\b|\bthis\s+week.s?\s+(?:\w+\s+)?(?:shuffles?|news|round[\-\s]?up|update)\b|\bnews\s+from\s+\w+(?:\s+\w+){0,3}(?:\s*,\s*(?:and\s+)?\w+(?:\s+\w+){0,3}){2,}",
    "press_source_opinion": r"^[\w\-À-ſ]+(?:\s+\w+){0,3}\s*:\s*why\s+\w",
    "opinion_piece": r"\b(?:an\s+)?(?:opinion|market\s+analysis|analysis|commentary|editorial)[\s/]+(?:piece|article|column)\b",
    "taking_steps_to_scout": r"\btaking\s+steps?\s+to\s+(?:identify|find|locate|select|engage|partner)\b",
    "people_departure_transition": r"\b(?:steps?\s+down|stepping\s+down|leaves?|left|resign\w*|depart\w*|dimission\w*|lascia|lasciat\w+|abbandona|succession\w*|succeed\w*|replac\w+)\b",
    "senior_role_hint": r"\b(?:ceo|cfo|coo|cio|cto|chief\s+\w+\s+officer|managing\s+director|director|head\s+of|partner|president|chair(?:man|woman)?)\b",
}

#: Patterns of single rules.
SINGLE: dict[str, str] = {
    "annual_dated": r"\b\d+(?:st|nd|rd|th)?\s+annual\b.{0,80}\b\d{1,2}/\d{1,2}/\d{4}\b",
    "press_review": r"\b(?:rassegna\s+stampa|press\s+review)\b",
    "press_review_title": r"^(?:press\s+review|rassegna\s+stampa)\s*:",
    "talk_series": r"(?:#\w+talk\b|\bpodcast\s+(?:series|episode|ep\.?)|\bwebinar\s+series)\b",
    "open_call": r"\bcall\s+for\s+(?:applications?|proposals?|startups?)\b",
    "currency_amount": r"[€$£]\s*\d+",
    "exploratory": r"\b(?:exploratory|indagine\s+di\s+mercato)\s+(?:survey|sondaggio)\b",
    "outsourced_control": r"\boutsourcing\s+of\s+(?:internal\s+)?(?:audit|compliance|risk)\b",
    "investor_event": r"\binvestor\s+(?:meeting|day|conference|summit)\b",
    "research_summary": r"\bsummary\s+of\s+research\s+conducted\b",
    "court": r"\b(?:court\s+case|legal\s+dispute|wins\s+case|lawsuit|lawyer|judge)\b",
    "market_move": r"\b(?:collapses?|plunges?|soars?|storm|volatility|stock\s+market)\b",
    "trading_floor": r"^\s*trading\s+floor\s*:",
    "price_move": r"\b(?:rises?|rose|fell|falls?|gains?|gained|drops?|dropped|jumps?|jumped|climbs?|climbed|slips?|slid|surges?|surged|tumbles?|tumbled)\s+(?:by\s+)?\d+(?:\.\d+)?\s*%",
    "anti_competitive": r"\banti-?competitive\b",
    "competition_probe": r"\b(?:investigation|probe|conduct|authority|antitrust|inquiry|regulator)\b",
    "series_opening": r"\b(?:series|ciclo|rassegna)\b.*\b(?:dedicated|dedicat[oa]|kicks?\s+off|al\s+via)\b",
    "commentary": r"\b(?:opinion|analysis|commentary|point\s+of\s+view|outlook|forecast|perspectives?|riflessioni)\b",
    "essay_title": r"\b(?:what\s+it\s+(?:really\s+)?takes|how\s+to\s+|why\s+we\s+(?:don.?t|believe|think)|lessons?\s+(?:from|learned))\b",
    "private_matching": r"\bprivate\s+matching\b",
    "that_is_why": r"\bthat.?s\s+why\s+we\b",
    "coalition": r"\bcoalition\s+(?:launched|formed|created|established)\b",
    "crossroads": r"\bcrossroads?\s+of\b|\bfrontier\s+of\b",
    "monetary": r"€\s*\d|\$\s*\d|\b\d+\s*(?:milion|million|mln|miliard|billion)\b",
    "notice": r"^(?:notice|avviso)\s*:",
    "weighing_sale": r"\b(?:evaluat|consider|explor|weigh|assess)\w*\s+(?:the\s+)?(?:sale|disposal|divestiture|exit)\b",
    "selected": r"\b(?:select(?:s|ed)?|chosen|appoint(?:s|ed)?|retain(?:s|ed)?|win(?:s)?|award(?:s|ed)?)\b",
    "mandate": r"\b(?:manag(?:e|es|ement)|administer|oversee|mandate|advisory)\b",
    "acquires_name": r"\bacquires?\s+\w+",
    "new_portfolio_detected": r"new portfolio company detected",
    "sale_announced": r"\b(?:announc\w+\s+the\s+sale|completes?\s+(?:the\s+)?sale|agreement\s+to\s+sell|puts?\s+up\s+for\s+sale)\b",
    "sale_agreed": r"\b(?:announc\w+\s+the\s+sale|agreement\s+to\s+sell|completes?\s+(?:the\s+)?sale)\b",
    "seller_named": r"\b(?:sellers?\s+(?:are|is|include)\b)",
    "obtains_credit": r"\bobtains?\s+[€$£]?\s*\d+.*?\b(?:financ\w+|credit|loan|facility)\b",
    "obtains_credit_from": r"\bobtains?\b.*\b(?:financ\w+|credit|loan|facility)\b.*\bfrom\b",
    "stake_sold": r"\b(?:sells?|sold|divests?|divested|cede|ceduto)\s+(?:(?:\w+|[\d.]+%?)\s+)?(?:stake|position|shares?|interest|partecipazione|quota)\b",
    "buying": r"\b(?:acquir\w+|acquis\w+|acquisizion\w+|rileva|entra\s+(?:nel\s+capitale|in)\b|enters?\s+capital|buys?|compra|tratt[ai]\s+l[''’]acquisto)\b",
    "invest_in": r"\binvest\w+\s+(?:in|nel|nella|nei|nelle|da|per)\b",
    "acquisition_by": r"\b(?:acquisition|acquisizione)\s+(?:by|da\s+parte\s+di)\b",
    "insolvency": r"\b(?:composition\s+with\s+creditors?|compulsory\s+(?:administrative\s+)?liquidation|insolvency\s+proceedings?|concordato\s+preventivo)\b",
    "funds_provided": r"\b(?:provid\w+|announc\w+|secur\w+)\s+(?:up\s+to\s+)?[€$£]?\s*\d+.*?\b(?:financ\w+|loan|credit)\b",
    "capex": r"\binvest\w*\b.{0,80}\b(?:plant|facility|facilities|production|impianto|stabilimento|infrastruttur\w+|site|manufacturing|centre|center|capacity|expansion|hub)\b|\b(?:plant|facility|facilities|production|impianto|stabilimento)\b.{0,60}\binvest\w*\b",
    "owner_then_capex": r"\(\s*[a-zA-Z][a-zA-Z\s&,]{1,29}\s*\)[\s\S]*\b(?:invest\w*|plant|facility|facilities|production|impianto|stabilimento|infrastruttur\w+|site|manufacturing|centre|center|capacity|expansion|hub)\b",
    "launch_of_partnership": r"\b(?:launch(?:es|ed)?|lancia|lancio)\b.{0,30}\b(?:partnership|collaborazione|accordo|alleanza)",
    "launched_years_ago": r"\blaunched?\s+in\s+20(?:1\d|2[0-4])\b",
    "board_acts": r"\bboard\s+of\s+directors?\s+(?:approves?|reviews?|examines?|met|meeting)\b",
    "statements": r"\b(?:financial\s+(?:position|statements?|results?|report)|net\s+(?:financial|revenue|profit|loss)|quarterly|half[\s\-]year|bilancio|rendiconto|semestrale|trimestrale)\b",
    "join_forces": r"\bjoin\s+forces\b",
    "joins_council": r"\bjoins?\s+(?:the\s+)?(?:technical|scientific|advisory)[\s\-]+(?:council|committee|board)\b",
    "hired": r"\b(?:appoint\w*|nomin\w*|hired?)\b",
    "joins": r"\b(?:joins?|aderisce|entra\s+in)\b",
    "backs_growth": r"\b(?:support\w*\s+(?:the\s+)?(?:group|company|growth)|growth\s+plan|multi-year|piano\s+di\s+crescita|investe|invest\w+\s+in)\b",
    "hired_as": r"\b(?:appoint\w*|nomin\w*|hired?|as\s+(?:managing|director|partner|head|chief|ceo|cfo|coo|cto))\b",
    "programme": r"\b(?:hub|program|partner|fund|fondo|initiative|corporate|accelerat|platform)\b",
    "named_as": r"\b(?:named?\s+as|hired?|promot\w+|new\s+(?:hire|appointment))\b",
    "parent_company": r"\b(?:is|acts?\s+as)\s+the\s+(?:parent|holding)\s+company\b|\b(?:parent|holding)\s+company\s+of\b|\bsociet[aà]\s+capogruppo\b",
    "resigns": r"\b(?:dimission\w+|resign\w+|leaves?)\b",
    "capital_raised": r"\b(?:aumento\s+di\s+capitale|round\s+da|incassa|raccog\w+|investi\w+\s+(?:di|da|per|in)\s+|invests?\s+in\b|co[\-\s]?invest\w+|€\d+\s*[MB]\w*\s+invest\w+|\d+\s*M€?\s+invest\w+)\b",
    "named_or_signed": r"\b(?:nomin\w+|appoint\w+|hired?|joins?|joined|firmato|signed|accordo|agreement)\b",
    "opens_office": r"\bopen(?:s|ed|ing)?\s+(?:a\s+|new\s+|its\s+)?(?:\w+\s+)?(?:office|presenza|sede|branch)\b",
    "vehicle": r"\b(?:sgr|fund|fondo|vehicle|veicolo|capital|lp|partnerships?)\b",
    "role_title": r"\b(?:managing\s+director|head\s+of|chief\s+\w+\s+officer|partner|president|vice\s+president|director\s+of|responsabile\s+(?:di|del|della))\b",
    "fund_title": r"\b(?:fund|fondo|capital|sgr|invest|acqui|rais|portfolio|raises?|launch|exit)\b",
    "appointment_stated": r"\b(?:appoint\w+|nomin\w+|hired?|named?|promot\w+|resign\w+|leaves?|steps?\s+down|stepping\s+down)\b",
    "forces_joined": r"\bjoin(?:s|ed)?\s+forces\b",
    "bought": r"\b(?:acquir\w+|acquisizion\w+|rileva|buys?|compra|entra\s+(?:nel\s+capitale|in)\b)\b",
}

#: A strategy that isn't a purchase, and the patterns that mustn't see it.
MASK = r"\bbuys?[\-\s]and[\-\s]builds?\b"
MASKED = ("acquisition_verbs", "has_any_pe_verb")
