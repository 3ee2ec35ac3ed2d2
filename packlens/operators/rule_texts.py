"""Names, texts and references of the 38 checks, in rulebook order.

``%s`` and ``%.1f`` stand for values of the package. Severity and weight belong to
an outcome, not to a rule, and are given with the outcomes in ``rules``.
"""

# Rule id -> name.
NAMES = {
    "R03_SCOPE": "Retail Scope (Rule 3)",
    "R26_EXEMPTION": "Exemption Check (Rule 26)",
    "R05_STD_QTY": "Standard Quantity (Rule 5)",
    "R06_NAME": "Commodity Name (Rule 6)",
    "R10_MFR_NAME": "Manufacturer/Packer Name (Rule 10)",
    "R10_ADDRESS": "Complete Address (Rule 10)",
    "R11_NET_QTY": "Net Quantity (Rule 11)",
    "R13_UNITS": "Quantity Unit (Rule 13)",
    "R12_QTY_FMT": "Quantity Format (Rule 12)",
    "R06_MRP": "MRP Declaration (Rules 6/18)",
    "R06_MRP_TAX": "MRP Tax-Inclusive Wording (Rule 6)",
    "R06_COO": "Country of Origin (Rule 6)",
    "R18_MRP_ALTER": "MRP Not Altered (Rule 18)",
    "R06_DATE": "Packing Date (Rule 6)",
    "R06_CONSUMER": "Consumer Care Contact (Rule 6)",
    "R09_LEGIBLE": "Legibility (Rule 9)",
    "R09_CONTRAST": "Contrast (Rule 9)",
    "R08_PDP": "Principal Display Panel (Rule 8)",
    "R08_CLEAR": "Clear Space (Rule 8)",
    "R07_FONT": "Font Size (Rule 7)",
    "R09_LIQUID": "Liquid Readability (Rule 9)",
    "R09_WRAPPER": "Wrapper Declarations (Rule 9)",
    "R09_LANG": "Language Requirement (Rule 9)",
    "R23_DECEPTIVE": "Deceptive Package (Rule 23)",
    "R22_MPE": "Maximum Permissible Error (Rule 22)",
    "R19_STAT_AVG": "Statistical Average (Rule 19)",
    "R19_IND_MPE": "Individual MPE (Rule 19)",
    "R19_SAMPLE": "Sample Declarations (Rule 19)",
    "R24_WHOLESALE": "Wholesale Declarations (Rule 24)",
    "R25_EXPORT": "Export Relabelling (Rule 25)",
    "R27_REG": "Registration (Rules 27-30)",
    "R31_AD": "Advertisement (Rule 31)",
    "B01_GTIN_STRUCT": "Bar Code Structure (Rule 6(10))",
    "B02_GTIN_CHECKSUM": "Bar Code Check Digit (Rule 6(10))",
    "B03_GTIN_SCOPE": "Bar Code Is a Trade Item (Rule 6(10))",
    "B04_GS1_AUTHORITY": "GS1 Issuing Authority",
    "B05_REGISTRY_ID": "Registry Identification (Rule 6(1)(a))",
    "B06_ORIGIN_CONSISTENCY": "Origin vs GS1 Prefix Cross-check",
}

# Texts that several rules share.
VISUAL = "Requires visual inspection of the physical label — not determinable from bar-code registry data alone."
ABSENT_REGISTRY = "%s is not carried in the bar-code registry data. It may still be printed on the pack — verify against the physical label."
ABSENT_LABEL = "%s is missing from the label."

# What is missing, by rule, and the rule's reference then.
ABSENT = {
    "R06_NAME": ("Common/generic name of the commodity", "Rule 6(1)(b)"),
    "R10_MFR_NAME": ("Name of the manufacturer / packer / importer", "Rule 6(1)(a) / Rule 10"),
    "R10_ADDRESS": ("Complete address of the manufacturer / packer / importer (with PIN code)", "Rule 6(1)(a) / Rule 10"),
    "R11_NET_QTY": ("Net quantity declaration", "Rule 6(1)(c) / Rule 11"),
    "R13_UNITS": ("Standard unit of weight/measure/number for the net quantity", "Rule 6(1)(c) / Rule 13"),
    "R06_MRP": ("Maximum Retail Price (MRP, inclusive of all taxes)", "Rule 6(1)(e) / Rule 18"),
    "R06_DATE": ("Month and year of manufacture / pre-packing / import", "Rule 6(1)(d)"),
    "R06_CONSUMER": ("Consumer care details (name/designation, address, phone, e-mail)", "Rule 6(1)(f)"),
}

# Rules with one outcome: status, severity, text, reference; their weight is 0.
CONSTANT = {
    "R26_EXEMPTION": ("NOT_APPLICABLE", "MINOR", "Exemption status cannot be determined from image alone.", "Rule 26"),
    "R09_LIQUID": ("NOT_APPLICABLE", "MINOR", "Cannot determine liquid readability from image alone.", "Rule 9"),
    "R09_WRAPPER": ("NOT_APPLICABLE", "MINOR", "Outer wrapper compliance requires physical inspection.", "Rule 9"),
    "R23_DECEPTIVE": ("INCONCLUSIVE", "CRITICAL", "Requires physical measurement to determine if package is deceptive.", "Rule 23"),
    "R22_MPE": ("NOT_APPLICABLE", "MAJOR", "MPE compliance requires physical weight measurement.", "Rule 22 / First Schedule"),
    "R19_STAT_AVG": ("NOT_APPLICABLE", "MAJOR", "Statistical lot testing requires physical sampling.", "Rule 19"),
    "R19_IND_MPE": ("NOT_APPLICABLE", "MAJOR", "Individual package MPE requires physical measurement.", "Rule 19"),
    "R19_SAMPLE": ("NOT_APPLICABLE", "MAJOR", "Sample-level declaration check requires physical inspection.", "Rule 19"),
    "R27_REG": ("INCONCLUSIVE", "MINOR", "Registration status cannot be verified from package image alone.", "Rules 27-30"),
    "R31_AD": ("NOT_APPLICABLE", "MINOR", "Advertisement compliance check not applicable to package images.", "Rule 31"),
}

# The other outcomes' texts.
TEXTS = {
    "scope_wholesale": "Wholesale package — retail chapter does not apply.",
    "scope_over": "Net quantity %s %s exceeds 25 kg/L retail scope limit.",
    "scope_pass": "Package is within retail scope.",
    "standard_none": "Net quantity not extracted — cannot verify against Second Schedule.",
    "standard_open": "Commodity type required to check Second Schedule standard quantities.",
    "name_pass": "Commodity name found: '%s'",
    "party_pass": "Name found: '%s'",
    "address_pass": "Address found on label.",
    "quantity_pass": "Net quantity: %s %s",
    "quantity_value": "%s %s",
    "unit_pass": "Unit '%s' (%s) declared.",
    "unit_warning": "Unit '%s' found but category unresolved.",
    "format_pass": "Quantity format appears correct.",
    "format_open": "Cannot verify quantity format without extracted value and unit.",
    "price_pass": "MRP found: ₹%.2f",
    "price_value": "₹%.2f",
    "tax_none": "No MRP extracted — cannot check the 'inclusive of all taxes' wording.",
    "tax_pass": "MRP is declared as inclusive of all taxes.",
    "tax_open": "MRP value known but the 'inclusive of all taxes' wording could not be verified from the available data — check the physical label.",
    "tax_fail": "MRP is printed without the mandatory 'inclusive of all taxes' qualifier.",
    "origin_pass": "Country of origin declared: %s.",
    "origin_fail": "Package appears to be imported but the country of origin is not declared.",
    "origin_none": "No indication the package is imported — country of origin not mandatory.",
    "altered_fail": "MRP appears to have been altered or obscured.",
    "altered_pass": "MRP appears unaltered.",
    "date_pass": "Date found: %s",
    "care_pass": "Consumer care contact found.",
    "legible_none": "OCR confidence not available to assess legibility.",
    "legible_pass": "Label appears legible (OCR confidence: %.0f%%).",
    "legible_fail": "Poor legibility — low OCR confidence (%.0f%%). Text may be too small or unclear.",
    "contrast_none": "Contrast ratio not measured (calibration may be missing).",
    "contrast_pass": "Adequate contrast ratio: %.1f:1",
    "contrast_value": "%.1f:1",
    "contrast_fail": "Insufficient contrast ratio: %.1f:1 (minimum 3.0:1 required).",
    "panel_pass": "Declarations are on the principal display panel.",
    "panel_warning": "Could not confirm all declarations are on the principal display panel.",
    "clear_none": "Clear space cannot be measured without font calibration.",
    "clear_pass": "Sufficient clear space around quantity declaration.",
    "clear_fail": "Insufficient clear space: ",
    "clear_vertical": "above=%.1fmm below=%.1fmm (need ≥%.1fmm). ",
    "clear_horizontal": "left=%.1fmm right=%.1fmm (need ≥%.1fmm).",
    "font_none": "Font size not measured (provide package height for calibration).",
    "font_price": "MRP font %.2fmm < %.1fmm minimum",
    "font_quantity": "Net qty font %.2fmm < %.1fmm minimum",
    "font_value": "MRP:%smm, Qty:%smm",
    "font_pass": "Font sizes meet minimum requirement (≥%.1fmm).",
    "language_pass": "Declarations found in: %s.",
    "language_fail": "No Hindi (Devanagari) or English text detected on the label.",
    "wholesale_none": "Not a wholesale package.",
    "wholesale_pass": "Wholesale package declarations appear present.",
    "wholesale_fail": "Wholesale package is missing required declarations.",
    "export_none": "Not an imported/export package.",
    "export_pass": "Importer name and address present on label.",
    "export_fail": "Imported package missing importer name/address — may not be properly relabelled.",
    "struct_none": "No bar code was scanned or supplied.",
    "struct_pass": "Bar code is a valid %s number.",
    "struct_fail": "'%s' is not a valid GTIN length (expected 8, 12, 13 or 14 digits).",
    "check_none": "Check digit could not be evaluated.",
    "check_pass": "GS1 mod-10 check digit matches — the number is internally consistent.",
    "check_fail": "GS1 check digit is wrong — the bar code number is mistyped or misprinted.",
    "trade_none": "No bar code supplied.",
    "trade_fail": "Bar code uses a reserved prefix (%s); it does not identify a consumer package and must not be printed as the product GTIN.",
    "trade_range": "restricted range",
    "trade_pass": "Bar code prefix is in the normal GTIN range for trade items.",
    "authority_none": "GS1 prefix does not map to any known member organisation.",
    "authority_india": "Prefix 890 — the bar code number is licensed through GS1 India, consistent with a package manufactured or packed in India.",
    "authority_india_value": "GS1 India (890)",
    "authority_pass": "Bar code number is licensed through the GS1 organisation for: %s.",
    "registry_pass": "GTIN resolved in: %s. Brand owner / product is on public record.",
    "registry_warning": "GTIN is structurally valid but is not listed in GS1 India, Open Food Facts or the other registries checked — the manufacturer/packer declaration cannot be independently corroborated from the bar code. Verify against the physical label.",
    "match_none": "No country of origin available to cross-check against the GS1 prefix.",
    "match_warning": "Declared origin '%s' differs from the GS1 licensing economy '%s'. The GS1 prefix is not proof of origin; confirm against the label.",
    "match_value": "declared=%s; prefix=%s",
    "match_pass": "Declared origin '%s' is consistent with the GS1 licensing economy.",
}
