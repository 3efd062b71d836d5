"""Explicit schemas of the inputs, so that no reader has to infer types."""

from __future__ import annotations

RIDES = """ride_id string, rideable_type string, started_at timestamp, ended_at timestamp,
           member_casual string"""

DAILY_ACTIVITY = """Id long, ActivityDate string, TotalSteps int, FairlyActiveMinutes int,
                    LightlyActiveMinutes int, SedentaryMinutes int, VeryActiveMinutes int,
                    Calories int"""
SLEEP_DAY = "Id long, SleepDay string, TotalMinutesAsleep int, TotalTimeInBed int"
HOURLY_STEPS = "Id long, ActivityHour string, StepTotal int"
HOURLY_CALORIES = "Id long, ActivityHour string, Calories int"
HOURLY_INTENSITIES = "Id long, ActivityHour string, TotalIntensity int"

HOUSE_SALES = """id long, price double, waterfront int, floors double, lat double, bathrooms double,
                 bedrooms int, view int, grade int, sqft_basement int, sqft_living15 int,
                 sqft_above int, sqft_living int"""

CAR_SALES = """Year int, Month string, Recession int, Vehicle_Type string, Automobile_Sales double,
               Price double, GDP double, Seasonality_Weight double, unemployment_rate double,
               Advertising_Expenditure double"""

LAUNCH_TABLE = """Date date, Launch_Site string, Payload_Mass double, Customer string,
                  Booster_Version string, Landing_Outcome string, Mission_Outcome string"""

LAUNCHES = """rocket string, payloads array<string>, launchpad string,
              cores array<struct<core: string, flight: int, gridfins: boolean, legs: boolean,
                                 reused: boolean, landing_success: boolean, landing_type: string,
                                 landpad: string>>,
              flight_number long, date_utc string"""
ROCKETS = "id string, name string"
LAUNCHPADS = "id string, name string, longitude double, latitude double"
PAYLOADS = "id string, mass_kg double, orbit string"
CORES = "id string, block int, reuse_count int, serial string"

PRICES = "Date date, Close double"
HTML_PAGES = "page_id long, html string"

PERSONALITY = """Time_spent_Alone double, Stage_fear string, Social_event_attendance double,
                 Going_outside double, Drained_after_socializing string, Friends_circle_size double,
                 Post_frequency double, Personality string"""

NETWORK_LOG = """event_id long, ts timestamp, attack_type string, protocol string, transport string,
                 packet_length int, ioc_detected boolean, account string, source_address string,
                 resource string"""
