"""The same reports in plain SQL over the test tables, written from the report rules.

``INPUTS`` restates the adapters' mappings; each oracle lists the inputs it uses
and reads them as common table expressions.
"""

from __future__ import annotations

from opslens.operators.customers import INACTIVE_DAYS, PROFILE_METRICS

from .queries import EVENT_WEEKS, MONTHS, SNAPSHOTS, STEP_START, YEARS

S1, S2 = "unsatisfactory_customer_support_on_call_email", "overall_service_took_more_time_than_promised"
Q1, Q2 = "unsatisfactory_quality_iron_packaging", "unsatisfactory_quality_wash_dry_clean"
L1, L2 = "delivery_not_done_in_requested_time", "pick_up_not_done_in_requested_time"

_SLOT_TEXT = "(8 + 2 * ({k} % 6)) || '-' || (10 + 2 * ({k} % 6))"
_VISIT_STATUS = """CASE WHEN l_returnflag = 'A' THEN 'done' WHEN l_returnflag = 'R' THEN 'cancelled'
    WHEN l_linestatus = 'F' THEN 'cancelled' ELSE 'scheduled' END"""
_BASE = "(TIMESTAMP '1995-01-01' + to_days(CAST(l_orderkey % 2400 AS INTEGER)))"

INPUTS = {
    "raw_bookings": f"""
    SELECT o_orderkey AS k, o_custkey AS c, *,
      CASE WHEN o_orderkey % 37 = 0 THEN 0.0 ELSE floor(o_totalprice / 1000) END::DOUBLE AS amt,
      CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'cancelled'
           WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'service_complete' ELSE 'closed' END
           WHEN o_orderkey % 5 = 0 THEN 'payment_pending' ELSE 'in_service' END AS st
    FROM orders""",
    "bookings": f"""
    SELECT k AS booking_id,
      CASE WHEN k % 13 = 0 THEN k WHEN k % 11 = 0 THEN k - 11 END AS parent_id,
      CASE WHEN k % 101 <> 0 THEN c END AS phone,
      CASE WHEN k % 5 <> 0 THEN 'Name ' || c || '-' || (k % 3) END AS customer_name,
      CASE WHEN k % 4 <> 0 THEN 'c' || c || '@example.com' END AS email,
      'NATION_' || (c % 25) AS city,
      CASE WHEN k % 53 <> 0 THEN 'loc_' || (c % 200) END AS locality,
      CASE WHEN c % 5 = 0 THEN 'Laundry' WHEN c % 5 = 1 THEN 'Regular Laundry'
           WHEN c % 5 = 2 THEN CASE WHEN k % 10 = 0 THEN 'Regular Laundry' ELSE 'Laundry' END
           WHEN k % 43 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Laundry' WHEN k % 3 = 1 THEN 'Regular Laundry'
           ELSE 'Household' END AS category,
      CASE WHEN c % 10 = 0 THEN 'Dry Cleaning' WHEN k % 97 = 0 THEN NULL
           WHEN k % 2 = 0 THEN 'Dry Cleaning' ELSE 'Wash and Iron' END AS type,
      st AS status, o_orderdate AS requested_date, {_SLOT_TEXT.format(k='k')} AS requested_time,
      amt AS amount,
      CASE WHEN k % 17 <> 0 THEN amt * 0.125::DOUBLE END AS taxes,
      CASE WHEN k % 6 <> 0 THEN amt * 0.25::DOUBLE * (k % 4) END AS discount_amount,
      CASE WHEN k % 9 = 0 THEN NULL WHEN k % 7 = 0 THEN -16.0 ELSE (k % 5) * 8.0 END::DOUBLE AS credits_used,
      CASE WHEN k % 19 <> 0 THEN ((k % 50) * 4.0)::DOUBLE END AS customer_credits,
      CASE WHEN k % 3 = 0 THEN 'CPN' || (k % 10) END AS coupon,
      CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS referred,
      CASE WHEN k % 26 = 0 THEN 'Rescheduled' END AS rescheduled_redo,
      CASE WHEN k % 7 <> 0 THEN left(o_orderpriority, 1)::DOUBLE END AS feedback,
      CASE WHEN k % 29 <> 0 THEN (c % 6)::DOUBLE END AS rating,
      CASE k % 8 WHEN 1 THEN '{S1}' WHEN 3 THEN '{S1},{Q2}' WHEN 5 THEN '{L1},{L2},{Q1}' WHEN 6 THEN '{S2}'
           END AS bad_rating_reason,
      CASE WHEN st = 'cancelled' AND k % 31 <> 0 THEN CASE k % 6 WHEN 0 THEN 'customer_cancellation'
           WHEN 1 THEN 'reschedule_by_customer' WHEN 2 THEN 'stock_out' WHEN 3 THEN 'out_of_geographical_area'
           WHEN 4 THEN 'reschedule_stock_out' ELSE 'wrong_booking' END END AS cancel_reason,
      CASE WHEN st = 'cancelled' AND k % 7 <> 0 THEN 'reason_' || (k % 3) END AS booking_cancel_reason,
      CASE WHEN k % 23 <> 0 THEN (k % 4)::DOUBLE END AS cancelled_pickup_visits,
      CASE WHEN k % 71 <> 0 THEN CASE WHEN k % 2 = 0 THEN '  SP ' ELSE 'sp ' END || (c % 60) || ' ' END AS pickup_by,
      CASE WHEN k % 3 = 0 THEN ' Sp ' ELSE 'SP ' END || (c % 45) AS delivery_by,
      CASE WHEN k % 12 <> 0 THEN o_orderdate + to_days(CAST(k % 5 + 1 AS INTEGER)) + to_hours(k % 10)
           END AS delivery_scheduled_time,
      CASE WHEN k % 7 = 0 THEN NULL WHEN left(o_orderpriority, 1)::INT < 3 THEN -1
           WHEN left(o_orderpriority, 1)::INT = 3 THEN 0 ELSE 1 END AS nps,
      strftime(o_orderdate, '%Y-%m') AS booking_month
    FROM raw_bookings""",
    "priced": """
    SELECT * EXCLUDE (taxes, discount_amount, credits_used), d AS discount_amount, t AS taxes, cr AS credits_used,
      amount + t AS total_revenue, amount + t - d - cr AS amp, amount - d - cr AS actual_paid
    FROM (SELECT *, coalesce(discount_amount, 0) AS d, coalesce(taxes, 0) AS t,
                 CASE WHEN credits_used > 0 THEN credits_used ELSE 0 END AS cr FROM bookings)""",
    "success": """
    SELECT * FROM priced
    WHERE status IN ('closed', 'service_complete', 'in_service', 'payment_pending') AND phone IS NOT NULL""",
    "segments": """
    SELECT phone,
      CASE WHEN premium = n THEN 'only premium' WHEN regular = n THEN 'only regular'
           WHEN gmv <> 0 AND premium_gmv / gmv < 0.1 THEN 'only regular'
           WHEN gmv <> 0 AND regular_gmv / gmv < 0.1 THEN 'only premium'
           ELSE 'both premium & regular' END AS customer_segment,
      CASE WHEN premium = n AND not_dry = 0 THEN 1 END AS only_dc
    FROM (SELECT phone, count(*) AS n,
        count(*) FILTER (category = 'Laundry') AS premium,
        count(*) FILTER (category = 'Regular Laundry') AS regular,
        count(*) FILTER (type NOT LIKE '%Dry%') AS not_dry,
        coalesce(sum(amount) FILTER (category = 'Laundry'), 0) AS premium_gmv,
        coalesce(sum(amount) FILTER (category = 'Regular Laundry'), 0) AS regular_gmv,
        coalesce(sum(amount) FILTER (category IS NOT NULL), 0) AS gmv
      FROM {source} WHERE phone IS NOT NULL GROUP BY phone)""",
    "ratings": """
    SELECT phone, n AS successful_bookings, 0.5::DOUBLE * (
        CASE WHEN s / n <= 2 THEN 1 WHEN s / n <= 54 THEN 2 WHEN s / n <= 149 THEN 3
             WHEN s / n <= 249 THEN 4 ELSE 5 END + least(n, 5)) AS rating
    FROM (SELECT phone, count(requested_date) AS n, sum(amp) AS s FROM {source}
          WHERE phone IS NOT NULL GROUP BY phone)""",
    "numbered": """
    SELECT *, row_number() OVER (PARTITION BY phone ORDER BY requested_date, booking_id) AS nr,
      row_number() OVER (PARTITION BY phone ORDER BY requested_date DESC, booking_id) AS rev
    FROM success""",
    "enriched": """
    SELECT s.booking_id, s.phone, s.status, s.requested_date, s.booking_month, s.total_revenue, s.amp,
      l.customer_credits, r.successful_bookings, f.booking_month AS cohort_group,
      CASE WHEN f.referred = 1 AND f.coupon IS NOT NULL THEN 'Both Marketing & Referral'
           WHEN f.referred = 1 THEN 'Only Referral' WHEN f.coupon IS NOT NULL THEN 'Only Marketing'
           ELSE 'Organically' END AS acquisition_source,
      g.customer_segment, g.only_dc, s.nr::INT AS booking_count, r.rating,
      CASE WHEN s.rescheduled_redo IS NULL AND EXISTS (SELECT 1 FROM success p
           WHERE p.phone = s.phone AND p.booking_id = s.parent_id) THEN 1 END AS duplicate_booking,
      CASE WHEN s.nr = 1 THEN 'first_booking' ELSE 'repeat_booking' END AS new_repeat,
      s.nps, s.feedback, s.customer_name, s.email, s.locality, s.city
    FROM numbered s JOIN numbered f ON f.phone = s.phone AND f.nr = 1
    JOIN numbered l ON l.phone = s.phone AND l.rev = 1
    JOIN segments g ON g.phone = s.phone JOIN ratings r ON r.phone = s.phone""",
    "weekly": f"""
    SELECT *, CASE {' '.join(f"WHEN requested_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'"
                             for n, a, b in YEARS[:-1])} ELSE 'W8' END AS week
    FROM bookings""",
    "pickup_visits": f"""
    SELECT l_orderkey AS booking_id, {_BASE} AS requested_date, slot,
      CASE WHEN l_partkey % 17 <> 0 THEN slot + to_minutes(30 * ((l_partkey + l_suppkey) % 14 - 4)) END AS updation_time,
      CASE WHEN l_partkey % 19 <> 0 THEN slot + to_minutes(30 * (l_partkey % 9 - 4)) END AS creation_time,
      CASE WHEN l_partkey % 23 <> 0 THEN slot + to_minutes(30 * (l_suppkey % 11 - 3)) END AS cancellation_time,
      CASE WHEN l_partkey % 13 <> 0 THEN CASE l_partkey % 8
        WHEN 0 THEN 'not_available_at_the_address' WHEN 1 THEN 'out_of_geographical_area'
        WHEN 2 THEN 'not_able_to_locate_the_address' WHEN 3 THEN 'not_opening_the_door'
        WHEN 4 THEN 'unfavourable_weather_conditions' WHEN 5 THEN 'Others ' WHEN 6 THEN 'Vehicle broke down'
        ELSE 'No cash' END END AS reason,
      {_VISIT_STATUS} AS visit_status
    FROM (SELECT *, {_BASE} + to_hours(8 + 2 * (l_orderkey % 6)) AS slot FROM lineitem)""",
    "slotted": """
    SELECT *,
      CASE visit_status
        WHEN 'done' THEN CASE WHEN updation_time <= slot THEN 'picked_before_slot'
          WHEN updation_time <= slot + INTERVAL 1 HOUR THEN 't-t+1'
          WHEN updation_time <= slot + INTERVAL 2 HOUR THEN 't+1-t+2'
          WHEN updation_time <= slot + INTERVAL 3 HOUR THEN 't+2-t+3' ELSE '>t+3' END
        WHEN 'cancelled' THEN CASE WHEN cancellation_time <= slot THEN 'cancelled_before_slot'
          WHEN cancellation_time <= slot + INTERVAL 1 HOUR THEN 't-t+1'
          WHEN cancellation_time <= slot + INTERVAL 2 HOUR THEN 't+1-t+2' ELSE '>t+2' END
      END AS updation_slot,
      CASE WHEN visit_status NOT IN ('done', 'cancelled') THEN NULL
        WHEN creation_time <= slot THEN '<t' WHEN creation_time <= slot + INTERVAL 30 MINUTE THEN 't to t+.5'
        WHEN creation_time <= slot + INTERVAL 1 HOUR THEN 't+.5 to t+1' ELSE '>t+1' END AS creation_slot
    FROM pickup_visits""",
    "delivery_visits": f"""
    SELECT l_linenumber::BIGINT * 100000000000000 + l_partkey * 10000000 + l_suppkey AS visit_id,
      l_orderkey AS booking_id,
      CASE WHEN l_orderkey % 10 <> 0 THEN strftime(base + INTERVAL 2 DAY, '%Y-%m-%d') END AS requested_date,
      CASE WHEN l_orderkey % 10 <> 0 AND l_orderkey % 16 <> 0
           THEN base + INTERVAL 2 DAY + to_hours(8 + 2 * (l_orderkey % 6)) END AS slot,
      CASE WHEN l_partkey % 17 <> 0 THEN base + INTERVAL 2 DAY + to_hours(l_partkey % 24) END AS updation_time,
      base + to_days(l_linenumber - 1) + to_hours(l_partkey % 24) AS creation_time,
      CASE WHEN l_suppkey % 9 <> 0 THEN base + to_days(l_linenumber % 4) + to_hours(l_partkey % 24)
           + to_minutes(l_suppkey % 60) END AS cancellation_time,
      CASE WHEN l_partkey % 13 <> 0 THEN CASE l_partkey % 7
        WHEN 0 THEN 'not_available_at_address' WHEN 1 THEN 'not_able_to_locate_the_address'
        WHEN 2 THEN 'not_opening_the_door' WHEN 3 THEN 'cash_not_available'
        WHEN 4 THEN 'traffic_problem' WHEN 5 THEN 'DB_refused_to_go' ELSE 'Other' END END AS reason,
      {_VISIT_STATUS} AS visit_status,
      CASE l_orderkey % 4
        WHEN 1 THEN [base + INTERVAL 1 DAY + to_hours(l_orderkey % 10)]
        WHEN 2 THEN [base + INTERVAL 1 DAY + to_hours(l_orderkey % 10), base + INTERVAL 2 DAY + to_hours(l_orderkey % 10)]
        WHEN 3 THEN [base + to_hours(l_orderkey % 10), base + INTERVAL 1 DAY + to_hours(l_orderkey % 10),
                     base + INTERVAL 3 DAY + to_hours(l_orderkey % 10)] END AS ofd_list
    FROM (SELECT *, {_BASE} AS base FROM lineitem)""",
    # Walk the visits of each booking in visit order, carrying how many stamps are used up.
    "listed": """
    SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY visit_id) AS nr,
      coalesce(ofd_list, CASE WHEN bool_or(visit_status = 'done') OVER (PARTITION BY booking_id)
               THEN [max(creation_time) OVER (PARTITION BY booking_id)] END) AS stamps
    FROM {source}""",
    "walk": """
    SELECT booking_id, nr, visit_id, coalesce(cancellation_time >= stamps[1] AND len(stamps) > 1, false)::INT AS used,
           coalesce(cancellation_time >= stamps[1] AND len(stamps) > 1, false) AS took
    FROM listed WHERE nr = 1
    UNION ALL
    SELECT v.booking_id, v.nr, v.visit_id,
      w.used + coalesce(w.used < len(v.stamps) - 1 AND v.cancellation_time >= v.stamps[w.used + 1], false)::INT,
      coalesce(w.used < len(v.stamps) - 1 AND v.cancellation_time >= v.stamps[w.used + 1], false)
    FROM walk w JOIN listed v ON v.booking_id = w.booking_id AND v.nr = w.nr + 1""",
    "assigned": """
    SELECT v.*, CASE WHEN w.took THEN v.stamps[w.used] WHEN v.visit_status = 'done' THEN v.stamps[len(v.stamps)]
      END AS ofd_time, len(v.stamps) AS ofd_attempts
    FROM listed v JOIN walk w ON w.booking_id = v.booking_id AND w.nr = v.nr""",
    "calls": """
    SELECT event_id AS call_id, CASE WHEN inb THEN 'inbound' ELSE 'outbound' END AS direction,
      user_id::VARCHAR AS phone,
      CASE WHEN event_type = 'error' THEN 'missed-call' WHEN event_type IN ('view', 'click') THEN 'completed'
           WHEN event_type = 'purchase' OR inb THEN 'unsuccessful' ELSE 'missed-call' END AS status,
      ts AS start_time, CASE WHEN event_id % 41 <> 0 THEN value END AS billable_duration
    FROM (SELECT *, event_type IN ('error', 'view') OR (event_type = 'signup' AND event_id % 6 = 0) AS inb
          FROM events)
    WHERE (inb OR event_id % 12 IN (SELECT s_suppkey % 9 FROM supplier))
      AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-29'""",
    # The state of a phone after each call, carried from call to call.
    "ordered_calls": """
    SELECT *, row_number() OVER (PARTITION BY phone ORDER BY start_time, call_id) AS nr FROM calls""",
    "states": """
    SELECT phone, nr, call_id, status = 'missed-call' AS is_open,
      CASE WHEN status = 'missed-call' THEN start_time END AS t1, NULL::VARCHAR AS outcome, NULL::DOUBLE AS minutes
    FROM ordered_calls WHERE nr = 1
    UNION ALL
    SELECT c.phone, c.nr, c.call_id,
      CASE WHEN NOT s.is_open THEN c.status = 'missed-call'
           WHEN c.direction = 'inbound' THEN c.status <> 'completed' ELSE false END,
      CASE WHEN NOT s.is_open AND c.status = 'missed-call' THEN c.start_time ELSE s.t1 END,
      CASE WHEN NOT s.is_open THEN NULL
           WHEN c.direction = 'inbound' THEN CASE WHEN c.status = 'completed' THEN 'inb' END
           WHEN c.status = 'completed' THEN 'out_success' ELSE 'out_fail' END,
      CASE WHEN s.is_open AND (c.direction = 'outbound' OR c.status = 'completed')
           THEN floor((epoch_us(c.start_time) - epoch_us(s.t1)) / 1000000.0) % 86400 / 60.0 END
    FROM states s JOIN ordered_calls c ON c.phone = s.phone AND c.nr = s.nr + 1""",
    "callbacks": f"""
    SELECT c.call_id, c.phone, c.direction, c.start_time,
      CASE {' '.join(f"WHEN c.start_time BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' + INTERVAL 1 DAY THEN '{n}'"
                     for n, a, b in EVENT_WEEKS[:-1])} ELSE 'W8' END AS week,
      CASE WHEN e.is_open AND c.call_id = m.call_id THEN 'no_callback' ELSE s.outcome END AS callback_status,
      s.minutes AS callback_minutes
    FROM ordered_calls c JOIN states s ON s.phone = c.phone AND s.nr = c.nr
    JOIN (SELECT phone, arg_max(is_open, nr) AS is_open FROM states GROUP BY phone) e ON e.phone = c.phone
    LEFT JOIN (SELECT phone, arg_max(call_id, (start_time, -call_id)) AS call_id FROM calls
               WHERE status = 'missed-call' GROUP BY phone) m ON m.phone = c.phone""",
    "issues": """
    SELECT event_id AS issue_id, event_id AS booking_id,
      CASE event_id % 4 WHEN 0 THEN 'Dry Cleaning and Special Care' WHEN 1 THEN 'Wash and Iron by weight'
           WHEN 2 THEN 'Wash and Iron Prime' ELSE 'Household' END AS category,
      CASE event_type WHEN 'click' THEN 'Pickup' WHEN 'error' THEN 'Delivery' WHEN 'signup' THEN 'Wash quality'
           ELSE 'Other' END AS l1,
      CASE event_type WHEN 'click' THEN 'pickup' WHEN 'error' THEN 'delivery' WHEN 'view' THEN 'Quality'
           WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Refund' ELSE 'lost/ex' END
           ELSE CASE event_id % 3 WHEN 0 THEN 'Dry cleaning' WHEN 1 THEN 'Wash and iron prime'
                ELSE 'Wash and iron by weight' END END AS l2,
      CASE WHEN event_id % 37 = 0 THEN NULL
           WHEN event_type = 'view' THEN CASE event_id % 6 WHEN 0 THEN 'Bad packaging' WHEN 1 THEN 'Shrinkage'
             WHEN 2 THEN 'Wet clothes/Bad smell' WHEN 3 THEN 'others' WHEN 4 THEN 'stains_not_removed'
             ELSE 'ironing_issue' END
           ELSE CASE event_id % 6 WHEN 0 THEN 'Request for change in pick up time slot : early, late, reschedule'
             WHEN 1 THEN 'Pick up pending and was not done in the requested time slot'
             WHEN 2 THEN 'Customer not available in the requested time slot'
             WHEN 3 THEN 'Request for change in delivery time slot : early, late, reschedule'
             WHEN 4 THEN 'cancel booking' ELSE 'Others' END END AS l3,
      CASE WHEN event_id % 8 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'desk' ELSE 'internal' END END AS source,
      event_id % 5 IN (0, 1) AS mumbai, event_id % 9 IN (3, 7) AS by_closer,
      ts AS created_at, date_trunc('second', ts) + to_seconds(floor(value * 600)::BIGINT) AS closed_at,
      event_id % 10 = 0 AS active,
      CASE WHEN event_id % 31 <> 0 THEN value * 4 END AS response,
      CASE WHEN event_id % 43 <> 0 THEN value END AS hours
    FROM events""",
    "frt": f"""
    SELECT *, m - 600 * date_diff('day', start, start + to_microseconds(round(m * 60000000)::BIGINT)) AS frt
    FROM (SELECT *, response - floor((epoch_us(start) - epoch_us(created_at)) / 1000000.0) / 60.0 AS m
      FROM (SELECT *,
          CASE {' '.join(f"WHEN created_at BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' + INTERVAL 1 DAY THEN '{n}'"
                         for n, a, b in EVENT_WEEKS[:-1])} ELSE 'W8' END AS week,
          CASE WHEN hour(created_at) >= 22 THEN date_trunc('day', created_at) + INTERVAL 32 HOUR
               WHEN hour(created_at) < 8 THEN date_trunc('day', created_at) + INTERVAL 8 HOUR
               ELSE created_at END::TIMESTAMP AS start
        FROM issues
        WHERE created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-29'))""",
    "closed_issues": f"""
    SELECT *, CASE {' '.join(
        f"WHEN closed_at BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' + INTERVAL 1 DAY THEN '{n}'"
        for n, a, b in EVENT_WEEKS[:-1])} ELSE 'W8' END AS week
    FROM issues
    WHERE closed_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-29' AND NOT active""",
    "requested_issues": f"""
    SELECT i.*, b.requested_date, CASE {' '.join(
        f"WHEN requested_date BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' + INTERVAL 1 DAY THEN '{n}'"
        for n, a, b in YEARS[:-1])} ELSE 'W8' END AS week
    FROM issues i JOIN bookings b USING (booking_id)
    WHERE b.requested_date BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2004-01-01'""",
    "leads": """
    SELECT CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey + 100000000
                ELSE c_custkey END AS number, c_name AS name, c_mktsegment AS segment
    FROM customer, range(2) t(i) WHERE i = 0 OR c_custkey % 10 = 0""",
}

# Inputs that read other inputs.
_NEEDS = {
    "bookings": ["raw_bookings"], "priced": ["bookings"], "success": ["priced"], "numbered": ["success"],
    "enriched": ["numbered", "segments:success", "ratings:success"], "weekly": ["bookings"],
    "slotted": ["pickup_visits"], "listed:delivery_visits": ["delivery_visits"], "listed:wanted": ["wanted"],
    "walk": [], "assigned": ["walk"], "ordered_calls": ["calls"], "states": ["ordered_calls"],
    "callbacks": ["states"], "frt": ["issues"], "closed_issues": ["issues"],
    "requested_issues": ["issues", "bookings"], "wanted": ["delivery_visits"],
    "segments:success": ["success"], "ratings:success": ["success"],
    "segments:bookings": ["bookings"], "ratings:priced": ["priced"],
}
INPUTS["wanted"] = f"""
    SELECT *, CASE WHEN creation_time < TIMESTAMP '{STEP_START}' + INTERVAL 7 DAY THEN 'Jun-01 to Jun-07'
      WHEN creation_time < TIMESTAMP '{STEP_START}' + INTERVAL 14 DAY THEN 'Jun-08 to Jun-14'
      WHEN creation_time < TIMESTAMP '{STEP_START}' + INTERVAL 21 DAY THEN 'Jun-15 to Jun-21'
      ELSE 'Jun-22 to Jun-28' END AS week
    FROM delivery_visits WHERE visit_status IN ('done', 'cancelled')
      AND creation_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2004-01-01'"""


def _with(inputs: str, sql: str) -> str:
    """Prefix ``sql`` with the named inputs ('name' or 'name:source') and whatever they read."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in inputs.split():
        add(name)
    ctes = []
    for name in order:
        base, _, source = name.partition(":")
        ctes.append(f"{base} AS ({INPUTS[base].replace('{source}', source)})")
    return f"WITH RECURSIVE {', '.join(ctes)} {sql}"


def _box(inputs: str, source: str, keys: str, value: str) -> str:
    points = ", ".join(
        f"round(quantile_cont({value}, {q}), 6) AS p{int(round(q * 100))}" for q in (0.1, 0.25, 0.5, 0.75, 0.8, 0.9))
    return _with(inputs, f"""SELECT {keys}, count(*) AS n, round(avg({value}), 9) AS mean, {points}
        FROM {source} GROUP BY {keys}""")


def _nps(keys: str, source: str, where: str = "true", having: str = "true") -> str:
    return f"""SELECT {keys}, count(*) AS size, count(nps) AS count, round(avg(nps), 6) AS mean
        FROM {source} WHERE {where} GROUP BY {keys} HAVING {having}"""


_COMPLETED = "status IN ('closed', 'service_complete')"
_WEEK_SHARES = """SELECT week, round(neg / scored, 6) AS detractors, round(mid / scored, 6) AS neutrals,
      round(pos / scored, 6) AS promoters, round(pos / scored - neg / scored, 6) AS nps,
      requested, feedbacks, round(100.0::DOUBLE * feedbacks / requested, 6) AS response_pct
    FROM (SELECT week, nullif(count(*) FILTER (nps = -1), 0)::DOUBLE AS neg,
        nullif(count(*) FILTER (nps = 0), 0)::DOUBLE AS mid, nullif(count(*) FILTER (nps = 1), 0)::DOUBLE AS pos,
        count(*) AS requested, count(nps) AS feedbacks, nullif(count(nps), 0)::DOUBLE AS scored
      FROM {source} GROUP BY week)"""


def _reason_pct(reasons: list[str]) -> str:
    listed = ", ".join(f"'{r}'" for r in reasons)
    return _with("weekly", f"""SELECT nps_split, m.week, reason, round(n / (total * 0.01::DOUBLE), 6) AS pct FROM (
        SELECT CASE WHEN nps = -1 THEN '-ve' ELSE '+ve' END AS nps_split, week, reason, count(*)::DOUBLE AS n
        FROM (SELECT *, unnest(string_split(bad_rating_reason, ',')) AS reason FROM weekly)
        WHERE reason IN ({listed}) GROUP BY ALL) m
        JOIN (SELECT week, count(*) AS total FROM weekly GROUP BY week) t ON t.week = m.week""")


def _matrix(source: str, keys: str, cohort: str, revenue: str) -> str:
    shares = ", ".join(
        f"round({m}::DOUBLE / nullif(first_value({m}) OVER w, 0), 6) AS {m}_share"
        for m in ("users", "bookings", "revenue"))
    return f"""SELECT *, {shares} FROM (
        SELECT {keys}{cohort}, booking_month, count(DISTINCT phone) AS users, count(*) AS bookings,
          coalesce(sum({revenue}), 0)::DOUBLE AS revenue FROM {source} GROUP BY ALL)
        WINDOW w AS (PARTITION BY {keys}{cohort} ORDER BY booking_month)"""


_MONTHS = ", ".join(
    f"max(users) FILTER (booking_month = '{m}') AS \"{m}\"" for m in MONTHS)

_KEPT = ["not_opening_the_door", "unfavourable_weather_conditions", "not_able_to_locate_the_address", "Others ",
         "not_available_at_the_address"]
_HOME = ["cancelled_before_slot", "t-t+1", "t+1-t+2", ">t+2"]


def _distinct(ord_: int, name: str, where: str, source: str = "v") -> str:
    return f"SELECT {ord_} AS ord, '{name}' AS metric, count(DISTINCT booking_id)::DOUBLE AS value FROM {source} WHERE {where}"


def _listed(ord_: int, name: str, where: str, source: str = "v") -> str:
    return (f"SELECT {ord_}, '{name}', nullif(count(DISTINCT booking_id), 0)::DOUBLE FROM {source} WHERE {where}")


_LOST = "status = 'cancelled' AND coalesce(cancel_reason NOT LIKE '%stock_out%', true)"
_IDLE = """status = 'cancelled' AND coalesce(cancel_reason NOT IN ('reschedule_stock_out', 'stock_out'), true)
    AND cancelled_pickup_visits = 0"""
_ONCE = f"{_LOST} AND cancelled_pickup_visits = 1"
_LATE = "visit_status = 'done' AND updation_time > slot + INTERVAL 2 HOUR"
_PICKUP_PARTS = " UNION ALL ".join([
    _distinct(1, "requested", "true", "b"),
    f"SELECT 2, 'reschedule', count(*) FROM b WHERE {_IDLE} AND cancel_reason LIKE 'reschedule%'",
    f"SELECT 2, 'out_of_geographical_area', count(*) FROM b WHERE {_IDLE} AND cancel_reason = 'out_of_geographical_area'",
    f"""SELECT 2, 'others', count(*) FROM b WHERE {_IDLE} AND cancel_reason NOT LIKE 'reschedule%'
        AND cancel_reason NOT IN ('out_of_geographical_area', 'customer_cancellation')""",
    f"SELECT 3, booking_cancel_reason, count(*) FROM b WHERE {_IDLE} AND booking_cancel_reason IS NOT NULL GROUP BY ALL",
    "SELECT 4, 'pre_visit_SO/RSO', count(*) FROM b WHERE cancel_reason LIKE '%stock_out%' AND cancelled_pickup_visits = 0",
    _distinct(5, "post_visit_SO/RSO", "cancel_reason LIKE '%stock_out%' AND cancelled_pickup_visits IS DISTINCT FROM 0"),
    _distinct(6, "ppvc2", f"{_LOST} AND cancelled_pickup_visits >= 2"),
    _distinct(7, "ppvc1", _ONCE),
    *[_listed(8, r, f"{_ONCE} AND reason = '{r}'") for r in _KEPT],
    f"""SELECT 9, 'everything_else', coalesce(sum(n) FILTER (reason NOT IN ({', '.join(f"'{r}'" for r in _KEPT)})), 0)
        FROM (SELECT reason, count(DISTINCT booking_id) AS n FROM v WHERE {_ONCE} AND reason IS NOT NULL GROUP BY reason)""",
    *[_listed(10, s, f"""{_ONCE} AND visit_status = 'cancelled' AND reason = 'not_available_at_the_address'
        AND updation_slot = '{s}'""") for s in _HOME],
    _distinct(11, "before_slot_pikcup", "visit_status = 'done' AND updation_time < slot"),
    _distinct(12, "within_slot_pickup",
              "visit_status = 'done' AND updation_time >= slot AND updation_time <= slot + INTERVAL 2 HOUR"),
    *[_listed(13, s, f"{_LATE} AND updation_slot = '{s}'") for s in ("t+2-t+3", ">t+3")],
    *[_listed(14, s, f"{_LATE} AND creation_slot = '{s}'") for s in ("<t", "t to t+.5", "t+.5 to t+1", ">t+1")],
    f"""SELECT 15, 'bookings_with_creation_time>t+1_single_visit', count(*) FROM v
        WHERE {_LATE} AND creation_slot = '>t+1' AND cancelled_pickup_visits = 0""",
])
# The columns of a booking dump after its id, in order.
_BOOKING_CELLS = [
    "parent_id", "phone", "customer_name", "email", "city", "locality", "category", "type", "status", "requested_date",
    "requested_time", "amount", "taxes", "discount_amount", "credits_used", "customer_credits", "coupon", "referred",
    "rescheduled_redo", "feedback", "rating", "bad_rating_reason", "cancel_reason", "booking_cancel_reason",
    "cancelled_pickup_visits", "pickup_by", "delivery_by", "delivery_scheduled_time"]
_DUMPS = """,
        newer AS (SELECT * EXCLUDE (nps, booking_month) REPLACE (CASE WHEN booking_id % 4 <> 1 THEN status END AS status,
                    CASE WHEN booking_id % 5 <> 2 THEN feedback END AS feedback) FROM bookings WHERE booking_id % 3 <> 0),
        older AS (SELECT * EXCLUDE (nps, booking_month) REPLACE (CASE WHEN booking_id % 7 = 0 THEN 'in_service' ELSE status END
                    AS status, amount + 8.0::DOUBLE AS amount) FROM bookings WHERE booking_id % 3 <> 1)"""


def _ranked(sql: str, keys: str, sections: str) -> str:
    """Adds the rank of a reason in its section, by falling count."""
    return f"""SELECT *, CASE WHEN ord IN ({sections}) THEN row_number() OVER (
      PARTITION BY {keys} ORDER BY value DESC NULLS LAST, metric) END::INTEGER AS rank FROM ({sql})"""


_PICKUP_FUNNEL = _with("slotted bookings", f""",
    b AS (SELECT * FROM bookings WHERE status IN ('closed', 'service_complete', 'cancelled', 'in_service')),
    v AS (SELECT s.*, k.status, k.cancel_reason, k.cancelled_pickup_visits
          FROM slotted s JOIN bookings k ON k.booking_id = s.booking_id),
    parts AS ({_PICKUP_PARTS})
    SELECT ord, metric, round(value / (SELECT count(DISTINCT booking_id) FROM b), 6) AS value FROM parts
    UNION ALL SELECT 16, 'Requested_abs', count(DISTINCT booking_id) FROM b""")

_STEPS = ["<T", "T_T+0.5", "T+0.5_T+1", "T+1_T+1.5", "T+1.5_T+2", "T+2_T+3", "T+3_T+4", ">T+4"]
_ENDS = [0, 30, 60, 90, 120, 180, 240]
_HOURLY = ["delivered_before_slot", "t-t+1", "t+1-t+2", "t+2-t+3", "t+3-t+4", ">t+4"]


def _chain(column: str, labels: list[str], minutes: list[int]) -> str:
    steps = " ".join(f"WHEN {column} <= slot + INTERVAL {m} MINUTE THEN '{n}'" for n, m in zip(labels, minutes))
    return f"CASE {steps} ELSE '{labels[-1]}' END"


def _grid(labels: list[str], key: str) -> str:
    """Every label for every group, so that a label without rows still shows."""
    names = ", ".join(f"'{n}'" for n in labels)
    return f"(SELECT DISTINCT {key} FROM v) g, (SELECT unnest([{names}]) AS metric) l"


def _attempts(labels: list[str], key: str, first: int) -> str:
    parts = []
    for reached, title, blank in (("= 1", "single_ofd", "without_slot"), ("> 1", "multiple_ofd", "without_slot_mulOFD")):
        won = f"visit_status = 'done' AND ofd_attempts {reached}"
        parts += [
            f"SELECT {key}, {first}, '{title}', count(DISTINCT booking_id) FILTER ({won}) FROM v GROUP BY {key}",
            f"""SELECT {key}, {first + 1}, '{blank}', count(DISTINCT booking_id) FILTER ({won} AND requested_date IS NULL)
                FROM v GROUP BY {key}""",
            f"""SELECT g.{key}, {first + 2}, l.metric, c.n FROM {_grid(labels, key)}
                LEFT JOIN (SELECT {key}, updation_slot, count(DISTINCT booking_id) AS n FROM v
                  WHERE {won} AND requested_date IS NOT NULL GROUP BY ALL) c
                ON c.{key} = g.{key} AND c.updation_slot = l.metric""",
        ]
        first += 3
    parts.append(f"""SELECT {key}, {first}, 'total_bookings',
        count(DISTINCT booking_id) FILTER (visit_status = 'done' AND ofd_attempts = 1)
        + count(DISTINCT booking_id) FILTER (visit_status = 'done' AND ofd_attempts > 1) FROM v GROUP BY {key}""")
    return " UNION ALL ".join(parts)


_DELIVERY_FUNNEL = _with("listed:wanted assigned", f""",
    v AS (SELECT *, {_chain("CASE WHEN visit_status = 'done' THEN updation_time ELSE cancellation_time END",
                            _STEPS, _ENDS)} AS updation_slot FROM assigned),
    parts(week, ord, metric, value) AS (
      SELECT week, 1, 'total_visits', count(*)::DOUBLE FROM v GROUP BY week
      UNION ALL SELECT week, 2, 'ofd_visits', count(ofd_time) FROM v GROUP BY week
      UNION ALL SELECT week, 3, 'not_ofd_visits', count(*) - count(ofd_time) FROM v GROUP BY week
      UNION ALL SELECT week, 4, 'successful_deliveries', count(*) FILTER (visit_status = 'done') FROM v GROUP BY week
      UNION ALL SELECT week, 5, 'ofd_unsuccessful', count(ofd_time) - count(*) FILTER (visit_status = 'done')
        FROM v GROUP BY week
      UNION ALL SELECT week, CASE WHEN ofd_time IS NULL THEN 7 ELSE 6 END, reason, count(*) FROM v
        WHERE visit_status = 'cancelled' AND reason IS NOT NULL GROUP BY ALL
      UNION ALL SELECT g.week, 8, l.metric, c.n FROM {_grid(_STEPS, "week")}
        LEFT JOIN (SELECT week, updation_slot, count(*) AS n FROM v
                   WHERE visit_status = 'cancelled' AND ofd_time IS NOT NULL GROUP BY ALL) c
        ON c.week = g.week AND c.updation_slot = l.metric
      UNION ALL {_attempts(_STEPS, "week", 9)})
    SELECT * FROM parts""")

_DELIVERY_V1 = _with("delivery_visits", f""",
    a AS (SELECT *, max(len(ofd_list)) OVER (PARTITION BY booking_id) AS ofd_attempts, 1 AS g1,
          CASE visit_status WHEN 'done' THEN {_chain("updation_time", _HOURLY, [0, 60, 120, 180, 240])} END AS updation_slot
          FROM delivery_visits),
    v AS (SELECT * FROM a WHERE creation_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2004-01-01'),
    t AS (SELECT count(*) AS total, coalesce(sum(ofd_attempts) FILTER (visit_status = 'done'), 0) AS ofd,
            count(DISTINCT booking_id) FILTER (visit_status = 'done') AS won FROM v),
    parts(g1, ord, metric, value) AS (
      SELECT 1, 1, 'total_visits', total::DOUBLE FROM t UNION ALL SELECT 1, 2, 'ofd_visits', ofd FROM t
      UNION ALL SELECT 1, 3, 'not_ofd_visits', total - ofd FROM t
      UNION ALL SELECT 1, 4, 'successful_deliveries', won FROM t
      UNION ALL SELECT 1, 5, 'ofd_unsuccessful', ofd - won FROM t
      UNION ALL {_attempts(_HOURLY, "g1", 6)})
    SELECT ord, metric, value FROM parts""")

_SNAPS = ", ".join(f"(TIMESTAMP '{d}', '{m}')" for d, m in SNAPSHOTS)


def _core(condition: str) -> str:
    return _with("enriched", f""",
    snaps(as_of, month) AS (VALUES {_SNAPS}),
    seen AS (SELECT as_of, month, e.* FROM enriched e JOIN snaps ON e.requested_date < as_of
             WHERE {_COMPLETED}),
    judged AS (SELECT as_of, phone, (count(*) = count(only_dc)) AS dc,
        date_diff('day', min(requested_date), as_of) / avg(successful_bookings) AS gap,
        avg(successful_bookings) AS n FROM seen GROUP BY as_of, phone),
    rows_ AS (SELECT s.as_of, s.month, s.phone, s.total_revenue, {condition} AS core
              FROM seen s JOIN judged j ON j.as_of = s.as_of AND j.phone = s.phone WHERE s.booking_month = s.month)
    SELECT as_of, month, count(DISTINCT phone) AS users,
      round(count(DISTINCT phone) FILTER (core) / count(DISTINCT phone)::DOUBLE, 6) AS core_share,
      sum(total_revenue)::DOUBLE AS gmv,
      round(coalesce(sum(total_revenue) FILTER (core), 0) / sum(total_revenue), 6) AS core_gmv_share
    FROM rows_ GROUP BY as_of, month""")


def _profile() -> str:
    picks = []
    for m in PROFILE_METRICS:
        e = f"e.{m}"
        bucket = f"CASE WHEN c.{m} <= {e}[2] THEN 1 WHEN c.{m} <= {e}[3] THEN 2 WHEN c.{m} <= {e}[4] THEN 3 " \
                 f"WHEN c.{m} <= {e}[5] THEN 4 ELSE 5 END"
        picks += [f"{bucket} AS {m}_bucket", f"round({e}[{bucket}], 6) AS {m}_lo", f"round({e}[{bucket} + 1], 6) AS {m}_hi"]
    cuts = ", ".join(f"quantile_cont({m}, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS {m}" for m in PROFILE_METRICS)
    return _with("priced", f""",
    c AS (SELECT phone, count(requested_date) AS bookings,
        date_diff('day', min(requested_date), TIMESTAMP '2002-01-01') / count(requested_date)::DOUBLE AS frequency,
        sum(actual_paid) / count(requested_date) AS avg_paid, sum(amount) / count(requested_date) AS avg_revenue
      FROM priced WHERE {_COMPLETED} AND phone IS NOT NULL GROUP BY phone),
    e AS (SELECT {cuts} FROM c)
    SELECT c.phone, c.bookings, {', '.join(f'round(c.{m}, 6) AS {m}' for m in PROFILE_METRICS)}, {', '.join(picks)}
    FROM c, e""")


def _first(col: str) -> str:
    return f"arg_min({col}, b.booking_id) FILTER ({col} IS NOT NULL)"


_IDLE_FLAGS = ", ".join(
    f"(TIMESTAMP '2001-08-15' - max(b.requested_date)) > INTERVAL {d} DAY + INTERVAL 23 HOUR "
    f"AS no_booking_in_last_{d}_days" for d in INACTIVE_DAYS)

_OLD_LABELS = """CASE l3 WHEN 'Request for change in pick up time slot : early, late, reschedule' THEN 'change_time_slot'
    WHEN 'Pick up pending and was not done in the requested time slot' THEN 'pickup_not_in_requested_slot'
    WHEN 'Customer not available in the requested time slot' THEN 'cust._not_available' ELSE
    CASE WHEN l2 = 'delivery' AND l3 = 'Request for change in delivery time slot : early, late, reschedule'
         THEN 'change_time_slot' ELSE l3 END END"""
_ISSUE_SHARE = f"""SELECT l2_subtype, week, l3_subtype, issues, total, round(100.0::DOUBLE * issues / total, 6) AS pct
    FROM (SELECT l2 AS l2_subtype, week, lab AS l3_subtype, count(*) AS issues,
            sum(count(*)) OVER (PARTITION BY l2, week)::BIGINT AS total
          FROM (SELECT *, {_OLD_LABELS} AS lab FROM closed_issues
                WHERE l2 IN ('pickup', 'delivery') AND source IS NOT NULL) GROUP BY l2, week, lab)
    WHERE l3_subtype IS NOT NULL"""

_VARIANTS = {
    "Overall": "true",
    "wo_garbage": "NOT (successful_bookings = 1 AND amp = 0)",
    "atleast_2_bookings": "successful_bookings > 1",
    "avg_feedback>=3": "avg_feedback >= 3",
    "profile=4,5": "rating > 3",
}
_LOCAL_VARIANTS = {
    "Overall": "true",
    "wo_garbage": "NOT (n = 1 AND actual_paid = 0)",
    "atleast_2_bookings": "n > 1",
    "profile=4,5": "rating > 3",
}


def _stack(variants: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS variant, * FROM {source} WHERE {c}" for n, c in variants.items())


ORACLES = {
    "merge_bookings": _with("bookings", f"""{_DUMPS}
        SELECT n.* FROM newer n ANTI JOIN older USING (booking_id)
        UNION ALL SELECT o.* FROM older o ANTI JOIN newer USING (booking_id)
        UNION ALL SELECT n.booking_id, {", ".join(f"coalesce(n.{c}, o.{c})" for c in _BOOKING_CELLS)}
        FROM newer n JOIN older o USING (booking_id)"""),
    "merge_dumps": _with("bookings", f"""{_DUMPS},
        oldest AS (SELECT * EXCLUDE (nps, booking_month) REPLACE ('closed' AS status, coalesce(feedback, 2.0::DOUBLE) AS feedback,
                     coalesce(taxes, 4.0::DOUBLE) AS taxes, NULL::VARCHAR AS email, NULL::VARCHAR AS locality)
                   FROM bookings WHERE booking_id % 5 < 3),
        stacked AS (SELECT *, 0 AS age FROM newer UNION ALL SELECT *, 1 FROM older UNION ALL SELECT *, 2 FROM oldest)
        SELECT booking_id, {", ".join(f"arg_min({c}, age) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _BOOKING_CELLS)}
        FROM stacked GROUP BY booking_id"""),
    "booking_revenue": _with("priced", """SELECT booking_id, booking_month, discount_amount, taxes, credits_used,
        total_revenue, amp, actual_paid FROM priced"""),
    "acquisition_source": _with("bookings", """SELECT phone,
        CASE WHEN referred = 1 THEN CASE WHEN coupon IS NULL THEN 'Only Referral' ELSE 'Both Marketing & Referral' END
             WHEN coupon IS NULL THEN 'Organically' ELSE 'Only Marketing' END AS acquisition_source
        FROM bookings WHERE phone IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY phone ORDER BY requested_date, booking_id) = 1"""),
    "customer_segment": _with("segments:bookings", "SELECT * FROM segments"),
    "customer_rating": _with("ratings:priced", "SELECT * FROM ratings"),
    "latest_credits": _with("bookings", """SELECT phone, customer_credits FROM bookings WHERE phone IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY phone ORDER BY requested_date DESC, booking_id) = 1"""),
    "duplicate_flag": _with("bookings", """SELECT booking_id, phone, parent_id,
        CASE WHEN rescheduled_redo IS NULL AND EXISTS (SELECT 1 FROM bookings p
             WHERE p.phone = b.phone AND p.booking_id = b.parent_id) THEN 1 END AS duplicate_booking FROM bookings b"""),
    "enrich_customers": _with("enriched", "SELECT * EXCLUDE (feedback, customer_name, email, locality, city) FROM enriched"),
    "booking_count_dump_order": _with("success", """SELECT booking_id, phone,
        row_number() OVER (PARTITION BY phone ORDER BY booking_id)::INT AS booking_count FROM success"""),
    "nps_by_month": _with("bookings", _nps("booking_month", "bookings", _COMPLETED)),
    "nps_by_month_city": _with("bookings", _nps("booking_month, city", "bookings", _COMPLETED)),
    "nps_by_week": _with("weekly", _nps("week", "weekly")),
    "good_localities": _with("bookings", _nps(
        "locality", "bookings", f"{_COMPLETED} AND locality IS NOT NULL", "count(*) > 5 AND avg(nps) > 0.1")),
    "reason_share": _with("bookings", f"""SELECT m.booking_month, reason, mentions, feedbacks,
        round(mentions / feedbacks::DOUBLE, 6) AS share
        FROM (SELECT booking_month, reason, count(*) AS mentions
              FROM (SELECT *, unnest(string_split(bad_rating_reason, ',')) AS reason FROM bookings WHERE {_COMPLETED})
              GROUP BY ALL) m
        JOIN (SELECT booking_month, count(nps) AS feedbacks FROM bookings WHERE {_COMPLETED} GROUP BY ALL) t
        ON t.booking_month = m.booking_month"""),
    "reason_counts": _with("weekly", """SELECT week, reason, feedback, count(*) AS mentions
        FROM (SELECT *, unnest(string_split(bad_rating_reason, ',')) AS reason FROM weekly)
        WHERE feedback IS NOT NULL GROUP BY ALL"""),
    "nps_weekly": _with("weekly", _WEEK_SHARES.replace("{source}", "weekly")),
    "nps_iso_weekly": _with("bookings", _WEEK_SHARES.replace(
        "{source}", "(SELECT *, 'W' || week(requested_date) AS week FROM bookings)")),
    "reason_pct_service": _reason_pct([S1, S2]),
    "reason_pct_quality": _reason_pct([Q1, Q2]),
    "reason_pct_logistics_wide": f"""SELECT nps_split, week,
        max(pct) FILTER (reason = '{L1}') AS {L1}, max(pct) FILTER (reason = '{L2}') AS {L2}
        FROM ({_reason_pct([L1, L2])}) GROUP BY ALL""",
    "cohort_matrix": _with("enriched", _matrix("enriched", "", "cohort_group", "total_revenue")),
    "cohort_users_wide": _with("enriched", f"""SELECT cohort_group, {_MONTHS} FROM (
        {_matrix("enriched", "", "cohort_group", "total_revenue")}) GROUP BY cohort_group"""),
    "cohort_variants": _with("enriched", f""",
        kept AS (SELECT *, avg(feedback) OVER (PARTITION BY phone) AS avg_feedback FROM enriched
                 WHERE cohort_group <> '1995-01'),
        stacked AS ({_stack(_VARIANTS, "kept")})
        {_matrix("stacked", "variant, ", "cohort_group", "total_revenue")}"""),
    "cohorts_for_good_localities": _with("priced", f""",
        good AS (SELECT locality FROM priced WHERE {_COMPLETED} AND locality IS NOT NULL GROUP BY locality
                 HAVING count(*) > 5 AND avg(nps) > 0.1),
        kept AS (SELECT *, min(booking_month) OVER (PARTITION BY phone) AS cohort_month,
                   count(requested_date) OVER (PARTITION BY phone) AS n
                 FROM priced WHERE locality IN (FROM good) AND status IN ('closed', 'service_complete', 'in_service')
                   AND booking_month <> '1999-06' AND phone IS NOT NULL),
        stacked AS ({_stack(_LOCAL_VARIANTS, "kept")})
        {_matrix("stacked", "variant, ", "cohort_month", "amount")}"""),
    "pickup_visit_slots": _with("slotted", """SELECT visit_status, updation_slot, creation_slot, count(*) AS visits
        FROM slotted GROUP BY ALL"""),
    "pickup_funnel": _ranked(_PICKUP_FUNNEL, "ord", "3"),
    "assign_ofd": _with("listed:delivery_visits assigned", """SELECT booking_id, visit_id,
        list_aggregate(list_transform(stamps, lambda x: strftime(x, '%Y-%m-%d %H:%M:%S')), 'string_agg', ',')
          AS ofd_happened_at, ofd_time, ofd_attempts::INT AS ofd_attempts FROM assigned"""),
    "delivery_funnel": _ranked(_DELIVERY_FUNNEL, "week, ord", "6, 7"),
    "delivery_funnel_v1": _DELIVERY_V1,
    "prepare_calls": _with("calls", "SELECT phone, call_id, direction, status, start_time, billable_duration FROM calls"),
    "callback_status": _with("callbacks", """SELECT call_id, phone, week, callback_status,
        round(callback_minutes, 6) AS callback_minutes FROM callbacks"""),
    "callback_kpis": _with("callbacks", """SELECT week, missed, inbound, round(100.0::DOUBLE * c20 / missed, 1) AS within_20_pct,
        round(100.0::DOUBLE * c60 / missed, 1) AS within_60_pct, round(100.0::DOUBLE * missed / inbound, 6) AS missed_pct,
        round(100.0::DOUBLE * none / missed, 1) AS no_callback_pct
        FROM (SELECT week, count(callback_status) AS missed, count(*) FILTER (direction = 'inbound') AS inbound,
          nullif(count(*) FILTER (callback_minutes <= 20), 0) AS c20,
          nullif(count(*) FILTER (callback_minutes <= 60), 0) AS c60,
          nullif(count(*) FILTER (callback_status = 'no_callback'), 0) AS none FROM callbacks GROUP BY week)"""),
    "callback_distribution": _box(
        "callbacks", "callbacks WHERE callback_status IS NOT NULL AND callback_status <> 'no_callback'",
        "callback_status, week", "callback_minutes"),
    "handling_time": _box(
        "callbacks", """(SELECT c.direction, c.status, b.week, c.billable_duration / 60.0::DOUBLE AS minutes
            FROM calls c JOIN callbacks b USING (call_id)) WHERE status IN ('completed', 'unsuccessful')""",
        "direction, status, week", "minutes"),
    "business_frt": _with("frt", """SELECT issue_id, week, start AS created_at, round(frt, 6) AS first_response_min
        FROM frt"""),
    "frt_kpis": _with("frt", """SELECT week, count(frt) AS issues,
        round(100.0::DOUBLE * nullif(count(*) FILTER (frt <= 20), 0) / count(frt), 1) AS within_20_pct,
        round(100.0::DOUBLE * nullif(count(*) FILTER (frt <= 60), 0) / count(frt), 1) AS within_60_pct
        FROM frt WHERE source IS NOT NULL AND frt IS NOT NULL GROUP BY week"""),
    "frt_distribution": _box("frt", "frt WHERE source IS NOT NULL AND frt IS NOT NULL", "week", "frt"),
    "frt_distribution_logistics": _box(
        "frt", """(SELECT *, l2 AS l2_subtype FROM frt)
            WHERE frt IS NOT NULL AND l2 IN ('pickup', 'delivery') AND (mumbai OR by_closer)""",
        "l2_subtype, week", "frt"),
    "resolution_time": _box(
        "closed_issues", """(SELECT *, lower(l2) AS l2_subtype FROM closed_issues
            WHERE l2 NOT IN ('Duplicate Booking', 'Feedback', 'Refund'))""", "l2_subtype, week", "hours"),
    "issue_share": _with("closed_issues", _ISSUE_SHARE),
    "issue_share_wide": _with("closed_issues", f"""SELECT l2_subtype, l3_subtype,
        {', '.join(f"max(pct) FILTER (week = '{n}') AS {n}" for n, _, _ in EVENT_WEEKS)}
        FROM ({_ISSUE_SHARE}) GROUP BY ALL"""),
    "unexplained_pickups": _with("closed_issues", """SELECT issue_id, week, l3 AS l3_subtype, source FROM closed_issues
        WHERE l2 = 'pickup' AND source IS NOT NULL AND l3 = 'Others'"""),
    "issue_share_by_request": _with("requested_issues", """SELECT l1_subtype, week, l3_subtype, issues, total,
        round(100.0::DOUBLE * issues / total, 6) AS pct
        FROM (SELECT l1 AS l1_subtype, week, l3 AS l3_subtype, count(*) AS issues,
                sum(count(*)) OVER (PARTITION BY l1, week)::BIGINT AS total
              FROM requested_issues WHERE l1 IN ('Pickup', 'Delivery') AND source IS NOT NULL AND NOT active
              GROUP BY l1, week, l3) WHERE l3_subtype IS NOT NULL"""),
    "quality_counts": _with("closed_issues", """SELECT CASE l3 WHEN 'Bad packaging' THEN 'A' WHEN 'Shrinkage' THEN 'E'
          WHEN 'Wet clothes/Bad smell' THEN 'F' WHEN 'ironing_issue' THEN 'G' WHEN 'others' THEN 'H' ELSE 'I' END
          AS l3_subtype, week,
        nullif(count(*) FILTER (category = 'Dry Cleaning and Special Care'), 0) AS dry_cleaning,
        nullif(count(*) FILTER (category = 'Wash and Iron by weight'), 0) AS by_weight,
        nullif(count(*) FILTER (category = 'Wash and Iron Prime'), 0) AS prime
        FROM closed_issues WHERE l2 = 'Quality' AND category <> 'Household' AND l3 IS NOT NULL GROUP BY ALL"""),
    "quality_counts_by_request": _with("requested_issues", """SELECT l2 AS product, l3 AS l3_subtype, week,
        count(*) AS issues FROM requested_issues
        WHERE l1 = 'Wash quality' AND requested_date >= DATE '1996-01-01' AND l3 IS NOT NULL GROUP BY ALL"""),
    "core_customers": _core("gap < CASE WHEN dc THEN 60 ELSE 20 END AND n > 1"),
    "core_customers_as_reported": _core("NOT dc AND gap < 20 AND n > 1"),
    "customer_profile": _profile(),
    "marketing_master": _with("enriched", f"""SELECT b.phone, {_first('customer_name')} AS customer_name,
        {_first('email')} AS email, {_first('locality')} AS locality, {_first('city')} AS city,
        {_first('rating')} AS rating, {_first('customer_credits')} AS customer_credits,
        {_first('customer_segment')} AS customer_segment, round(avg(feedback), 6) AS avg_feedback,
        count(requested_date) AS total_bookings, max(requested_date) AS last_booking_date, {_IDLE_FLAGS}
        FROM enriched b GROUP BY b.phone"""),
    "leads_without_bookings": _with("bookings leads", """SELECT DISTINCT number, name, segment FROM leads l
        WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.status IS DISTINCT FROM 'cancelled'
                          AND b.phone IS NOT DISTINCT FROM l.number)"""),
    "courier_productivity": _with("bookings", """,
        done AS (SELECT * FROM bookings WHERE status IN ('closed', 'service_complete', 'in_service')),
        p AS (SELECT lower(trim(pickup_by)) AS sp, strftime(requested_date, '%d') AS date, count(*) AS pickups FROM done
              WHERE strftime(requested_date, '%Y-%m') = '1998-07' AND pickup_by IS NOT NULL GROUP BY ALL),
        q AS (SELECT lower(trim(delivery_by)) AS sp, strftime(delivery_scheduled_time, '%d') AS date,
                count(*) AS deliveries FROM done
              WHERE strftime(delivery_scheduled_time, '%Y-%m') = '1998-07' GROUP BY ALL)
        SELECT sp, date, pickups, deliveries FROM p FULL JOIN q USING (sp, date)"""),
    "courier_first_rows": _with("bookings", """,
        done AS (SELECT * FROM bookings WHERE status IN ('closed', 'service_complete', 'in_service')),
        p AS (SELECT lower(trim(pickup_by)) AS sp, strftime(requested_date, '%d') AS date, count(*) AS pickups FROM done
              WHERE strftime(requested_date, '%Y-%m') = '1998-07' AND pickup_by IS NOT NULL GROUP BY ALL),
        q AS (SELECT lower(trim(delivery_by)) AS sp, strftime(delivery_scheduled_time, '%d') AS date,
                count(*) AS deliveries FROM done
              WHERE strftime(delivery_scheduled_time, '%Y-%m') = '1998-07' GROUP BY ALL)
        SELECT sp, date, pickups, deliveries FROM p FULL JOIN q USING (sp, date)
        ORDER BY sp NULLS FIRST, date NULLS FIRST LIMIT 10"""),
    "courier_extract": _with("bookings", f""",
        named AS (SELECT * REPLACE (lower(trim(pickup_by)) AS pickup_by, lower(trim(delivery_by)) AS delivery_by)
                  FROM bookings WHERE status IS DISTINCT FROM 'cancelled')
        SELECT 'delivery' AS role, delivery_by AS courier, booking_id, locality, status, requested_date,
          delivery_scheduled_time, CAST(delivery_scheduled_time AS DATE) AS delivery_date FROM named
        WHERE delivery_by IN ({', '.join(f"'sp {i}'" for i in range(20))})
          AND strftime(delivery_scheduled_time, '%Y-%m') = '1998-07'
        UNION ALL SELECT 'pickup', pickup_by, booking_id, locality, status, requested_date, delivery_scheduled_time,
          NULL::DATE FROM named WHERE pickup_by IN ('sp 3', 'sp 8')"""),
    "period_labels": _with("weekly", f"""SELECT
        CASE {' '.join(f"WHEN requested_date BETWEEN DATE '{a}' AND DATE '{b}' + INTERVAL 1 DAY THEN '{n}'"
                       for n, a, b in YEARS[:3])} ELSE 'W4' END AS first_match,
        week AS inclusive,
        CASE WHEN requested_date < DATE '{STEP_START}' + 7 THEN 'Jun-01 to Jun-07'
             WHEN requested_date < DATE '{STEP_START}' + 14 THEN 'Jun-08 to Jun-14'
             WHEN requested_date < DATE '{STEP_START}' + 21 THEN 'Jun-15 to Jun-21' ELSE 'Jun-22 to Jun-28' END AS stepped,
        'W' || week(requested_date) AS iso_week, count(*) AS bookings FROM weekly GROUP BY ALL"""),
    "period_table": _with("bookings", """,
        periods AS (SELECT s_suppkey % 50 AS ord, 'C' || s_suppkey % 500 AS label,
                      DATE '1995-01-01' + (s_suppkey * 37 % 2400)::INT AS first_day, s_suppkey % 41 - 1 AS length,
                      s_suppkey % 29 <> 0 AS begins FROM supplier),
        hits AS (SELECT booking_id, min({'ord': ord, 'label': label}) AS p FROM bookings JOIN periods
                 ON begins AND requested_date >= first_day
                   AND requested_date <= first_day + length::INT + INTERVAL 1 DAY GROUP BY booking_id)
        SELECT booking_id, requested_date, coalesce(p.label, 'none') AS campaign FROM bookings LEFT JOIN hits USING (booking_id)"""),
}

# The reports of the stored histories are those of the bookings themselves.
ORACLES["stored_reports"] = " UNION ALL BY NAME ".join(
    f"SELECT '{name}' AS report, * FROM ({ORACLES[name]})"
    for name in ("cohort_matrix", "cohort_variants", "core_customers", "marketing_master"))
