"""Rule tables of the email classifier, of intent, and of document types; all fixed values.

Patterns are Java regular expressions over upper-case text; they are literals of the plan, so each is
compiled once.
"""

# Fixed values: (name, category, text, weight, pattern); text is subject, body, body_head, sender or any.
EMAIL_RULES = [
    ("bl.subject.to-confirm-docs", "BL_COMPARISON", "subject", 4.0, r"^TO CONFIRM DOCS(?![A-Z])"),
    ("bl.subject.request-bl-draft", "BL_COMPARISON", "subject", 4.0, r"^REQUEST B/?L DRAFT(?![A-Z])"),
    ("bl.subject.draft-bl-amend", "BL_COMPARISON", "subject", 4.0, r"^DRAFT B/?L\b.*\bAMEND\b"),
    ("bl.subject.desk-code", "BL_COMPARISON", "subject", 4.0, r"^(?:AIE|AFPTME|AFRT|AFEMY)\s*-\s"),
    ("bl.subject.desk-code-shape", "BL_COMPARISON", "subject", 2.5, r"^(?!SI\b)[A-Z]{2,6}\s*-\s*[A-Z][A-Z _]{2,}\s*-\s*[A-Z]{2,}\([A-Z0-9]+\)"),
    ("bl.body.attached-si-and-draft-bl", "BL_COMPARISON", "body_head", 4.0, r"\bSI\b\s+AND\s+(?:THE\s+)?DRAFT\s+B/?L\b"),
    ("bl.body.si-and-bill-of-lading", "BL_COMPARISON", "body_head", 4.0, r"SHIPPING INSTRUCTION AND (?:THE )?DRAFT BILL OF LADING"),
    ("bl.body.check-draft-against-si", "BL_COMPARISON", "body_head", 4.0, r"\bCHECK\b[^.]{0,40}\bDRAFT\s+B/?L\b[^.]{0,20}\bAGAINST\b[^.]{0,20}\bSI\b"),
    ("bl.body.compare-si-and-bl", "BL_COMPARISON", "body_head", 4.0, r"\bCOMPARE\b[^.]{0,30}\bSI\b[^.]{0,20}\bB/?L\b"),
    ("bl.body.verify-bl-matches-si", "BL_COMPARISON", "body_head", 3.0, r"\bVERIFY\b[^.]{0,20}\bB/?L\b[^.]{0,20}\bMATCHES\b[^.]{0,20}\bSI\b"),
    ("bl.body.confirm-bl-in-order", "BL_COMPARISON", "body_head", 3.0, r"\bCONFIRM\b[^.]{0,20}\bB/?L\b[^.]{0,20}\bIN ORDER\b"),
    ("bl.body.assist-to-send-draft", "BL_COMPARISON", "body_head", 3.5, r"\b(?:ASSIST|HELP)\b[^.]{0,20}\b(?:SEND|ISSUE|PREPARE|PROVIDE|RELEASE)\b[^.]{0,20}\bDRAFT\s+B/?L\b"),
    ("bl.body.revert-with-discrepancy", "BL_COMPARISON", "body", 2.5, r"\bREVERT WITH ANY DISCREPANC"),
    ("bl.body.draft-bl-number", "BL_COMPARISON", "body", 2.0, r"\bDRAFT B/?L NO\b"),
    ("bl.body.for-checking", "BL_COMPARISON", "body_head", 1.5, r"\bFOR CHECKING\b"),
    ("si.subject.coded-line", "SI_REQUEST", "subject", 4.0, r"^SI\s*-\s*"),
    ("si.subject.cust-si", "SI_REQUEST", "subject", 4.0, r"\bCUST SI(?![A-Z])"),
    ("si.subject.request-si", "SI_REQUEST", "subject", 4.0, r"\bREQUEST SI(?![A-Z])"),
    ("si.subject.si-needed", "SI_REQUEST", "subject", 4.0, r"\bSI NEEDED(?![A-Z])"),
    ("si.body.please-find-shipping-instruction", "SI_REQUEST", "body_head", 4.0, r"\bFIND\b[^.]{0,20}\bSHIPPING INSTRUCTION\b"),
    ("si.body.structured-block", "SI_REQUEST", "body", 1.0, None),  # one point a distinct field labelled, up to BLOCK_CAP
    ("si.body.revert-with-draft-once-available", "SI_REQUEST", "body", 2.5, r"\bREVERT WITH\b[^.]{0,20}\bDRAFT B/?L\b[^.]{0,20}\bONCE AVAILABLE\b"),
    ("si.body.documents-required-list", "SI_REQUEST", "body", 1.5, r"\bDOCUMENTS REQUIRED\b"),
    ("inv.subject.billing", "INVOICE_QUERY", "subject", 3.0, r"\bBILLING\b"),
    ("inv.subject.missing-gr", "INVOICE_QUERY", "subject", 3.5, r"\bMISSING GR(?![A-Z])"),
    ("inv.subject.cancel-invoice", "INVOICE_QUERY", "subject", 4.0, r"\bCANCEL INVOICE(?![A-Z])"),
    ("inv.subject.local-charges", "INVOICE_QUERY", "subject", 3.5, r"\bLOCAL CHARGES(?![A-Z])"),
    ("inv.subject.dd-charges", "INVOICE_QUERY", "subject", 3.5, r"\bD\s*&\s*D CHARGES\b|\bDETENTION\b|\bDEMURRAGE\b"),
    ("inv.subject.telex-release-charges", "INVOICE_QUERY", "subject", 3.0, r"\bTELEX RELEASE CHARGES(?![A-Z])"),
    ("inv.subject.total-freight", "INVOICE_QUERY", "subject", 3.5, r"\bTOTAL FREIGHT(?![A-Z])"),
    ("inv.subject.invoice-word", "INVOICE_QUERY", "subject", 1.5, r"\bINVOICE\b|\bPAYMENT\b"),
    ("inv.body.invoice-number", "INVOICE_QUERY", "body_head", 2.5, r"\bINVOICE\s*#?\s*\d{4,}"),
    ("inv.body.thc-local-charge", "INVOICE_QUERY", "body_head", 2.5, r"\bTHC\b|\bLOCAL CHARGE"),
    ("inv.body.detention-demurrage", "INVOICE_QUERY", "body_head", 2.5, r"\bDETENTION\b|\bDEMURRAGE\b|\bD\s*&\s*D\b"),
    ("inv.body.reverse-pgi", "INVOICE_QUERY", "body_head", 3.0, r"\bREVERSE THE PGI\b"),
    ("inv.body.release-payment", "INVOICE_QUERY", "body_head", 2.0, r"\bRELEASE PAYMENT\b|\bPOST THE GR\b|\bPROCEED WITH BILLING\b"),
    ("inv.body.gr-missing", "INVOICE_QUERY", "body_head", 2.5, r"\bGR IS STILL MISSING\b|\bMISSING\b[^.]{0,20}\bGR\b"),
    ("gen.sender.role-mailbox", "GENERAL", "sender", 3.0, r"^(?:NOREPLY|NO-REPLY|DONOTREPLY|DO-NOT-REPLY|RPA\.?BOT|RPA-BOT|HR|OPERATIONS|DOCUMENTATION|NOTIFICATIONS?|ALERTS?)@"),
    ("gen.subject.update-summary", "GENERAL", "subject", 4.0, r"\bUPDATE SUMMARY(?![A-Z])"),
    ("gen.subject.berthing-report", "GENERAL", "subject", 4.0, r"\bBERTHING REPORT(?![A-Z])"),
    ("gen.subject.reminder-tag", "GENERAL", "subject", 4.0, r"_REMINDER_"),
    ("gen.subject.rpa-tag", "GENERAL", "subject", 3.5, r"_RPA_|\bRPA BOT(?![A-Z])"),
    ("gen.subject.outstanding-bl-list", "GENERAL", "subject", 4.0, r"\bOUTSTANDING B/?L(?![A-Z])"),
    ("gen.subject.pending-bl-release", "GENERAL", "subject", 4.0, r"\bPENDING B/?L RELEASE(?![A-Z])"),
    ("gen.subject.hr", "GENERAL", "subject", 4.0, r"\bTIME OFF REQUEST\b|\b_APPROVAL REQUIRED_\b|\bWELCOMING THE NEW YEAR\b|\bHAPPY NEW YEAR\b|\bDELIVERY PLANNING\b|\bMISS CONNECTION\b"),
    ("gen.body.automated-notification", "GENERAL", "body_head", 4.0, r"\bAUTOMATED NOTIFICATION\b|--\s*RPA BOT\b"),
    ("gen.body.no-action-required", "GENERAL", "body_head", 3.5, r"\bNO ACTION REQUIRED\b"),
    ("gen.body.circular-attachment", "GENERAL", "body_head", 4.0, r"\bLIST OF OUTSTANDING B/?L\b|\bBERTHING REPORT\b|\bUPDATE SUMMARY\b"),
    ("gen.body.submit-si-reminder", "GENERAL", "body_head", 4.0, r"\bSUBMIT SI\b(?:\s*(?:&|AND)\s*AED\b)?[^.]{0,60}\b(?:ALL PENDING|BY END OF DAY|SHIPMENTS)\b"),
    ("gen.body.office-notice", "GENERAL", "body_head", 4.0, r"\bWISHING EVERYONE\b|\bOFFICE RESUMES\b|\bLOADING COMPLETED, DOCUMENTS TO FOLLOW\b|\bKINDLY ACTION THE PENDING ITEMS\b"),
    ("gen.body.dear-team-broadcast", "GENERAL", "any", 0.5, r"^DEAR (?:TEAM|ALL)\b"),
    ("spam.sender.known-throwaway-domain", "SPAM", "sender", 5.0, r"@(?:PRIZE-CLAIMS\.INFO|PARCEL-TRACK\.CO|WEBMAIL-VERIFY\.CO|LOGISTICS-DEALS\.BIZ|CRYPTO-INVEST\.NET|SECURE-MAILBOX\.ORG)\b"),
    ("spam.sender.throwaway-domain-shape", "SPAM", "sender", 3.0, r"@[A-Z0-9.\-]*\b(?:PRIZE|CLAIM|WINNER|LOTTO|GIFT|VERIFY|SECURE-|CRYPTO|INVEST|DEALS|OFFERS?|PROMO|TRACK|MAILBOX|WEBMAIL)[A-Z0-9.\-]*\."),
    ("spam.sender.cheap-tld", "SPAM", "sender", 2.0, r"@[A-Z0-9.\-]+\.(?:INFO|BIZ|TOP|XYZ|CLICK|LIVE|ONLINE|SHOP|CLUB|WIN|LINK|ZIP)$"),
    ("spam.sender.bait-local-part", "SPAM", "sender", 2.0, r"^(?:WINNER|WINNERS|OFFERS|PROMO|DEALS|PRIZES|LOTTERY)@"),
    ("spam.text.prize", "SPAM", "any", 4.0, r"\bYOU HAVE WON\b|\bHAS BEEN SELECTED\b|\bGIFT CARD\b|\bCLAIM NOW\b|\bMONTHLY DRAW\b|\bCONGRATULATIONS!{2,}|\bFREE IPHONE\b|\bBRAND NEW IPHONE\b"),
    ("spam.text.parcel-fee", "SPAM", "any", 4.0, r"\bUNPAID CUSTOMS FEE\b|\bCOULD NOT BE DELIVERED\b|\bPARCEL WILL BE RETURNED\b|\bPARCEL (?:IS )?ON HOLD\b"),
    ("spam.text.mailbox-phish", "SPAM", "any", 4.0, r"\bSTORAGE (?:LIMIT|IS FULL|FULL)\b|\bEXCEEDED ITS STORAGE\b|\bMAILBOX\b[^.]{0,30}\bFULL\b|\bUNDELIVERED MESSAGES\b|\bVERIFY (?:YOUR )?ACCOUNT\b|\bUPDATE YOUR ACCOUNT\b"),
    ("spam.text.account-threat", "SPAM", "any", 3.0, r"\bAVOID (?:SUSPENSION|DEACTIVATION)\b|\bWITHIN \d+ HOURS?\b|\bIMMEDIATELY\b[^.]{0,20}\bACCOUNT\b|\bACCOUNT\b[^.]{0,20}\bIMMEDIATELY\b"),
    ("spam.text.money-scam", "SPAM", "any", 4.0, r"\bBITCOIN\b|\bGUARANTEED\s*\d*\s*%?\s*RETURNS?\b|\bBANK OFFICER\b|\bYOUR BANK DETAILS\b|\bBUSINESS PROPOSAL\b|\bUSD [\d.]+ MILLION\b"),
    ("spam.text.marketing-hype", "SPAM", "any", 3.0, r"\b\d{2,3}\s*%\s*OFF\b|\bLIMITED TIME OFFER\b|\bEXCLUSIVE OFFER\b|\bBUY NOW\b|\bWEIRD TRICK\b|\bTHIS WEEK ONLY\b|\bDEAL EXPIRES\b"),
    ("spam.text.adult", "SPAM", "any", 5.0, r"\bHOT SINGLES\b|\bIN YOUR AREA WANT TO\b"),
    ("spam.text.bait-link", "SPAM", "body", 2.5, r"HTTPS?://[A-Z0-9.\-]*(?:CLAIM|PRIZE|FREE-|VERIFY|TRACK-PARCEL|BIT\.LY)"),
    ("spam.text.mass-salutation", "SPAM", "any", 2.0, r"\bDEAR (?:VALUED CUSTOMER|USER|CUSTOMER|SIR/MADAM)\b|\bHELLO DEAR\b"),
    ("spam.text.click-here", "SPAM", "any", 2.0, r"\bCLICK HERE\b"),
]
BLOCK_CAP = 6

# Fixed values: (name, weight, pattern, text) of signs that documents are attached, and that a draft is asked for.
ATTACHED = [
    ("attach.attachments-dropped", 3.5, r"\bATTACHMENTS?\b[^.]{0,40}\b(?:DROPPED|MISSING|NOT COME THROUGH|DID NOT COME|FAILED TO ATTACH|STRIPPED)\b", "body"),
    ("attach.document-still-missing", 3.0, r"\b(?:DRAFT B/?L|B/?L|SI|SHIPPING INSTRUCTION|DOCUMENTS?|ATTACHMENTS?)\b[^.]{0,25}\b(?:IS|ARE)? ?STILL MISSING\b", "body"),
    ("attach.please-find-attached", 3.0, r"\b(?:PLEASE|KINDLY)\s+FIND\s+(?:ATTACHED|THE ATTACHED)\b[^.]{0,70}\b(?:SI|SHIPPING INSTRUCTION|DRAFT B/?L|BILL OF LADING|PACKING LIST|COMMERCIAL INVOICE|CERTIFICATE OF ORIGIN|DOCUMENTS?)\b", "body"),
    ("attach.attached-are", 3.0, r"\bATTACHED\s+(?:ARE|IS|HEREWITH|HERETO)\b", "body"),
    ("attach.attached-documents", 3.0, r"\bATTACHED\s+(?:THE\s+)?(?:SI\b|SHIPPING INSTRUCTION|DRAFT B/?L|BILL OF LADING)", "body"),
    ("attach.please-compare", 2.5, r"\b(?:PLEASE|PLS|KINDLY)\s+COMPARE\b", "body"),
    ("attach.check-against", 2.0, r"\bCHECK\b[^.]{0,40}\bAGAINST\b", "body"),
    ("attach.verify-matches", 2.0, r"\bVERIFY\b[^.]{0,25}\bMATCHES\b", "body"),
    ("attach.confirm-in-order", 2.0, r"\bCONFIRM\b[^.]{0,25}\bB/?L\b[^.]{0,20}\bIN ORDER\b", "body"),
    ("attach.enclosed", 1.5, r"\bENCLOSED\b|\bAS ATTACHED\b|\bIN THE ATTACHMENT\b", "body"),
]
DRAFT = [
    ("draft.assist-to-send", 3.5, r"\b(?:ASSIST|HELP)\b[^.]{0,20}\b(?:SEND|ISSUE|PREPARE|PROVIDE|RELEASE|SHARE)\b[^.]{0,25}\bDRAFT\b", "body"),
    ("draft.please-send-draft", 3.0, r"\b(?:PLEASE|PLS|KINDLY)\s+(?:SEND|ISSUE|PREPARE|PROVIDE|SHARE|FORWARD|RAISE)\b[^.]{0,25}\bDRAFT B/?L\b", "body"),
    ("draft.revert-once-available", 3.0, r"\bREVERT WITH\b[^.]{0,20}\bDRAFT B/?L\b[^.]{0,25}\bONCE AVAILABLE\b", "body"),
    ("draft.awaiting-draft", 2.0, r"\b(?:AWAIT(?:ING)?|PENDING|CHASING)\b[^.]{0,25}\bDRAFT B/?L\b|\bDRAFT B/?L\b[^.]{0,20}\b(?:NOT YET (?:ISSUED|READY)|ONCE READY)\b", "body"),
    ("draft.subject-request-bl-draft", 1.0, r"^REQUEST B/?L DRAFT(?![A-Z])", "subject"),
]

# Titles of documents, and (name, type, weight, pattern) of further signs; ^ is a line's start.
TITLES = [
    ("SHIPPING INSTRUCTION", "SHIPPING_INSTRUCTION"), ("SHIPPING INSTRUCTIONS", "SHIPPING_INSTRUCTION"), ("SHIPPERS INSTRUCTION", "SHIPPING_INSTRUCTION"),
    ("BILL OF LADING INSTRUCTION", "SHIPPING_INSTRUCTION"), ("BILL OF LADING INSTRUCTIONS", "SHIPPING_INSTRUCTION"), ("BL INSTRUCTION", "SHIPPING_INSTRUCTION"),
    ("B L INSTRUCTION", "SHIPPING_INSTRUCTION"), ("DRAFT BILL OF LADING", "BILL_OF_LADING"), ("OCEAN BILL OF LADING", "BILL_OF_LADING"),
    ("HOUSE BILL OF LADING", "BILL_OF_LADING"), ("BILL OF LADING", "BILL_OF_LADING"), ("COMMERCIAL INVOICE", "COMMERCIAL_INVOICE"),
    ("PROFORMA INVOICE", "COMMERCIAL_INVOICE"), ("TAX INVOICE", "COMMERCIAL_INVOICE"), ("PACKING LIST", "PACKING_LIST"), ("CERTIFICATE OF ORIGIN", "CERTIFICATE_OF_ORIGIN"),
]
DOC_SIGNALS = [
    ("label:B/L No.", "BILL_OF_LADING", 0.9, r"(?m)^(?:B L|BL|BILL OF LADING)\s+(?:NO|NOS|NUMBER|NBR)\b"),
    ("label:Invoice No.", "COMMERCIAL_INVOICE", 1.2, r"(?m)^INVOICE\s+(?:NO|NOS|NUMBER|DATE)\b"),
    ("label:Seller", "COMMERCIAL_INVOICE", 0.8, r"(?m)^SELLER\b"),
    ("label:Buyer", "COMMERCIAL_INVOICE", 0.8, r"(?m)^BUYER\b"),
    ("label:Total Amount", "COMMERCIAL_INVOICE", 1.0, r"(?m)^TOTAL\s+AMOUNT\b"),
    ("label:Payment Terms", "COMMERCIAL_INVOICE", 1.0, r"(?m)^PAYMENT\s+TERMS?\b"),
    ("label:Incoterms", "COMMERCIAL_INVOICE", 1.0, r"(?m)^INCOTERMS?\b"),
    ("text:Unit Price", "COMMERCIAL_INVOICE", 0.8, r"\bUNIT\s+PRICE\b"),
    ("text:Carton No.", "PACKING_LIST", 1.5, r"\bCARTONS?\s+(?:NO|NOS|NUMBER)\b"),
    ("text:Dimensions", "PACKING_LIST", 1.0, r"\bDIMENSIONS?\b"),
    ("text:Net Wt", "PACKING_LIST", 0.5, r"\bNET\s+(?:WT|WEIGHT)\b"),
    ("label:Certificate No.", "CERTIFICATE_OF_ORIGIN", 1.2, r"(?m)^CERTIFICATES?\s+(?:NO|NOS|NUMBER)\b"),
    ("label:Country of Origin", "CERTIFICATE_OF_ORIGIN", 1.2, r"(?m)^COUNTRY\s+OF\s+ORIGIN\b"),
    ("label:Issuing Authority", "CERTIFICATE_OF_ORIGIN", 1.0, r"(?m)^ISSUING\s+AUTHORITY\b"),
    ("label:Exporter", "CERTIFICATE_OF_ORIGIN", 0.5, r"(?m)^EXPORTERS?\b"),
]
BOOKING = r"(?m)^BOOKING\s+(?:REF|REFERENCE|NO|NOS|NUMBER)\b"
VESSEL = r"\b(?:VESSEL|VOYAGE|VOY|OCEAN CARRIER|EXPORT CARRIER)\b"
