"""Output labels that must equal the reference's report text."""

# Sourcing platforms, in the order the platform rule tests them.
PLATFORM_SWC = "Commbuys"
PLATFORM_BID_LOG = "Business Center"
PLATFORM_QUOTE = "FairMarkIt"
PLATFORM_NONE = "Uncategorized"

# Buyer classes of the cleaned-lines report.
CLASS_SOURCING_EXEC = "Sourcing Executive"
CLASS_NON_INVENTORY = "Non-Inventory Buyer"
CLASS_INVENTORY = "Inventory Buyer"
CLASS_OUTSIDE = "Buyer Outside P&L"
CLASS_ERROR = "ERROR"

# Buyer types of the platform reports.
TYPE_SWC = "SWC Buyer"
TYPE_SOURCING_EXEC = "Sourcing Executive"
TYPE_NON_INVENTORY = "Non-Inventory"
TYPE_INVENTORY = "Inventory"
TYPE_NONE = "NA"

# Spend bins, in report order, and the fall-through label.
BIN_LEVELS = ("Micro", "Small", "Large")
BIN_OTHER = "Other"

# Size split of uncategorized POs.
SIZE_UNDER = "<50,000"
SIZE_OVER = "50,000+"

# Label of the appended grand-total row; text R prints for a missing value.
TOTAL_LABEL = "Total"
NA_TEXT = "NA"

# Display names of the business-unit summary columns.
UNIT_SUMMARY_DISPLAY = {
    "year_spend": "Total Spend",
    "year_pos": "Total No. of POs",
    "period_a_spend": "Spend in April",
    "period_a_pos": "No. of POs in April",
    "period_b_spend": "Spend in May",
    "period_b_pos": "No. of POs in May",
}
