"""Label lists, replacement maps and patterns that results depend on."""

# Booking statuses.
SUCCESS_STATUSES = ["closed", "service_complete", "in_service", "payment_pending"]
COMPLETED_STATUSES = ["closed", "service_complete"]
COURIER_STATUSES = ["closed", "service_complete", "in_service"]
FUNNEL_STATUSES = ["closed", "service_complete", "cancelled", "in_service"]

# Rating bands, upper bound of revenue per booking and its score.
REVENUE_BANDS = [(2, 1), (54, 2), (149, 3), (249, 4)]

# Cohort months left out by default.
EXCLUDED_COHORTS = ["2016-09", "2015-04", "2015-05", "2015-06", "2015-07", "2015-08"]

# Bad-rating reasons by group.
SERVICE_REASONS = [
    "unsatisfactory_customer_support_on_call_email",
    "overall_service_took_more_time_than_promised",
]
QUALITY_REASONS = [
    "unsatisfactory_quality_iron_packaging",
    "unsatisfactory_quality_wash_dry_clean",
]
LOGISTICS_REASONS = [
    "delivery_not_done_in_requested_time",
    "pick_up_not_done_in_requested_time",
]

# Pickup visit cancel reasons, applied in this order.
PICKUP_REASON_RULES = [
    ("not.available.at.the.address.*", "not_available_at_the_address"),
    (".*geographical.*", "out_of_geographical_area"),
    ("not.able.to.locate.*.address.*", "not_able_to_locate_the_address"),
    ("not.opening.the.door.*", "not_opening_the_door"),
    (".*weather.*", "unfavourable_weather_conditions"),
]

# Delivery visit cancel reasons, applied in this order.
DELIVERY_REASON_RULES = [
    ("not.available.at.*.address.*", "not_available_at_address"),
    ("not.able.to.locate.the.address.*", "not_able_to_locate_the_address"),
    ("not.opening.the.door.*", "not_opening_the_door"),
    ("cash.not.available.*", "cash_not_available"),
    ("traffic.problem.*", "traffic_problem"),
    ("db.refused.*", "DB_refused_to_go"),
]

# Single-visit cancel reasons shown on their own in the pickup funnel.
PICKUP_KEPT_REASONS = [
    "not_opening_the_door",
    "unfavourable_weather_conditions",
    "not_able_to_locate_the_address",
    "Others ",
    "not_available_at_the_address",
]

# Slot steps as (hours after slot start, label), then the label for later.
PICKUP_DONE_STEPS = [(0, "picked_before_slot"), (1, "t-t+1"), (2, "t+1-t+2"), (3, "t+2-t+3")]
PICKUP_DONE_LATER = ">t+3"
CANCELLED_STEPS = [(0, "cancelled_before_slot"), (1, "t-t+1"), (2, "t+1-t+2")]
CANCELLED_LATER = ">t+2"
CREATION_STEPS = [(0, "<t"), (0.5, "t to t+.5"), (1, "t+.5 to t+1")]
CREATION_LATER = ">t+1"
HOURLY_DELIVERY_STEPS = [(0, "delivered_before_slot"), (1, "t-t+1"), (2, "t+1-t+2"), (3, "t+2-t+3"), (4, "t+3-t+4")]
HOURLY_DELIVERY_LATER = ">t+4"
DELIVERY_STEPS = [
    (0, "<T"),
    (0.5, "T_T+0.5"),
    (1, "T+0.5_T+1"),
    (1.5, "T+1_T+1.5"),
    (2, "T+1.5_T+2"),
    (3, "T+2_T+3"),
    (4, "T+3_T+4"),
]
DELIVERY_LATER = ">T+4"

# Call direction and status folding.
DIRECTION_MAP = {"outbound-api": "outbound", "outbound-dial": "outbound"}
CALL_STATUS_MAP = {"failed": "unsuccessful", "no-answer": "unsuccessful", "busy": "unsuccessful"}

# Issue relabelling.
OWNER_MAP = {
    "Mumbai Delivery ( After RFD )": "mumbai",
    "Mumbai Logistics (pickup)": "mumbai",
    "Bangalore logistics (pickup)": "bangalore",
    "Bangalore Delivery ( After RFD )": "bangalore",
    "CC_customers": "CC",
}
L2_MAP = {"Clothes Lost/Exchanged": "lost/ex"}
L3_MAP = {
    "Clothes not cleaned properly/Stain not removed": "stains_not_removed",
    "Ironing issue-Poor finishing/iron marks/Lint": "ironing_issue",
}
CATEGORY_MAP = {"Wash and Fold by weight": "Wash and Iron by weight"}
PICKUP_L3_MAP = {
    "Request for change in pick up time slot : early, late, reschedule": "change_time_slot",
    "Pick up pending and was not done in the requested time slot": "pickup_not_in_requested_slot",
    "Customer not available in the requested time slot": "cust._not_available",
}
DELIVERY_L3_MAP = {"Request for change in delivery time slot : early, late, reschedule": "change_time_slot"}
QUALITY_L3_MAP = {
    "Bad packaging": "A",
    "Color Fade/color change": "B",
    "Linen/embroidery damage": "C",
    "Post-Process Stains": "D",
    "Shrinkage": "E",
    "Wet clothes/Bad smell": "F",
    "ironing_issue": "G",
    "others": "H",
    "stains_not_removed": "I",
}
QUALITY_CATEGORIES = ["Dry Cleaning and Special Care", "Wash and Iron by weight", "Wash and Iron Prime"]
QUALITY_PRODUCTS = ["Dry cleaning", "Wash and iron prime", "Wash and iron by weight"]
UNTIMED_L2 = ["Duplicate Booking", "Feedback", "Refund"]
LOGISTICS_L2 = ["pickup", "delivery"]
