"""Row contracts, as DDL."""

from __future__ import annotations

PLAYER = "struct<name:string,country:string>"
TEAM = f"struct<name:string,players:array<{PLAYER}>>"
SCORE = "struct<sets:array<struct<a:string,b:string>>,winner:int>"
TOURNAMENT = (
    "struct<id:string,name:string,url:string,venue:string,address:string,organizer:string,"
    "organizer_url:string,ranking:string,start:date,end:date>"
)

MATCH_COLUMNS = {
    "id": "string", "source": "string", "federation": "string", "tournament": TOURNAMENT,
    "class_name": "string", "round": "string", "court": "string", "status": "string",
    "start_time": "string", "schedule": "string", "est_start": "string", "est_start_at": "timestamp_ntz",
    "day": "struct<n:int,label:string>", "teams": f"array<{TEAM}>", "score": SCORE,
}
MATCH = ", ".join(f"`{k}` {v}" for k, v in MATCH_COLUMNS.items())

ARCHIVE_FILE = (
    "`key` string, name string, federation string, tour string, `start` string, `end` string, source string,"
    "category string, address string, venue string, organizer string, organizerUrl string, noOrganizer boolean,"
    "matches array<struct<className:string,round:string,court:string,status:string,"
    f"teams:array<{TEAM}>,score:struct<sets:array<array<string>>,winner:int>>>,"
    "_corrupt_record string"
)

API_SIDE = "struct<Name:string,CountryShort:string,Player2Name:string,Player2CountryShort:string>"
API_MATCH = (
    "struct<Id:string,TournamentClassName:string,Draw:string,Court:string,Date:string,State:int,"
    f"Challenger:{API_SIDE},Challenged:{API_SIDE},"
    "MatchResult:struct<IsPlayed:boolean,Score:struct<IsFirstParticipantWinner:boolean,"
    "DetailedScoring:array<struct<FirstParticipantScore:string,SecondParticipantScore:string>>>>>"
)
API_PAYLOAD = f"event_id string, Matches array<{API_MATCH}>, _corrupt_record string"

FINAL_PLAYER = "struct<name:string,player_id:string>"
FINAL_ROW = (
    "circuit string, year string, tournament string, city string, country struct<name:string>,"
    "final_date string, gender string, score string,"
    f"winner_player {FINAL_PLAYER}, winner_partner {FINAL_PLAYER},"
    f"finalist {FINAL_PLAYER}, finalist_partner {FINAL_PLAYER}"
)
EXTRACTED_ROUND = (
    "`key` string, gender string, round string, winners array<string>, losers array<string>,"
    "score string, confidence string"
)
FOLLOWS = (
    "players map<string,struct<name:string>>, tournaments map<string,struct<name:string>>"
)
DRAW_CELL = (
    "path string, gender string, r int, c int, text string, `lines` array<string>, is_name boolean"
)
