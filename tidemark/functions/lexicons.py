"""Word lists and patterns whose values are fixed by the data they were made for."""

# Phrases of front matter, and the shape limits of a page without content.
BOILERPLATE_MARKERS = (
    "list of illustrations", "list of tables", "table of contents",
    "list of effective pages", "index of", "illustrations (cont",
)

# Fault words that count as salient wherever they stand.
FAULT_WORDS = (
    "undervolt", "venting", "bang", "barber", "amp spike", "restart", "zero",
    "quantity", "pressure", "fuel cell", "bus", "cryo", "oxygen", "helium",
    "gimbal lock", "vent", "cabin", "leak", "short", "alarm", "temperature",
)

# Capital phrases that are not salient.
CAPS_STOP = (
    "OK", "OKAY", "I", "A", "AND", "THE", "WE", "HOUSTON", "JACK", "JIM", "FRED",
    "RIGHT", "NOW", "MAIN", "STAND", "BY", "ROGER", "YES", "NO", "GO", "OVER",
)

# Words left out of a plain-language query.
FALLBACK_STOP = tuple(
    "the a an of to in on and or with at from for was were is are be been being this "
    "that these those it its they them their has had have will would could should may might not no nor "
    "due most probable caused cause failure failed fault anomaly report system during after before "
    "reported observed crew when then approximately about around also only which while into onto over "
    "under out off up down but if so as than very more less each any all some there here we i he she "
    "his her him our your at-the".split()
)

# Words without information about a component.
GENERAL_WORDS = tuple(
    "the a an of to in on and or with at from for during after before was were is are be this "
    "that these those it its they them their has had have will would could should may might not no non "
    "due most probable caused cause failure failed fault anomaly report system module assembly unit "
    "device component part condition normal nominal operation over under within candidate check next "
    "based given symptom source potential possible verify may causing related issue reading high low "
    "value indicates suggests one concrete drawn ending output relevant crew "
    "which whose indicated potentially malfunction insufficient".split()
)

# Stop words of the cause scorer.
SCORER_STOP = tuple(
    "the a an of to in on and or with at from for during after before was were is are be "
    "this that these those it its they them their has had have will would could should may might "
    "not no non due most probable caused cause failure failed fault anomaly report system module "
    "assembly unit device component part condition normal nominal operation over under within".split()
)

# Equipment outside the domain, tried left to right.
OUT_OF_DOMAIN = (
    r"rover", r"roving vehicle", r"\blrv\b",
    r"alsep", r"seismic experiment", r"thumper", r"magnetometer",
    r"deep[- ]core", r"core drill", r"spectrometer",
    r"lunar[- ]sounder", r"\bsounder\b", r"sim[- ]bay",
    r"cooling garment", r"\bplss\b", r"portable life support",
    r"\bmesa\b", r"sample return", r"sample container",
    r"panoramic camera", r"tv camera", r"television camera", r"surface camera",
)

# Subsystems that no manual covers.
OUT_SUBSYSTEMS = (
    "lrv", "rover", "alsep", "eva", "emu", "suit", "sim-bay", "sim bay", "experiment",
    "seismic", "magnetometer", "spectrometer", "drill", "sounder", "camera", "sample",
    "mesa", "surface", "geolog",
)

# The authoritative in-corpus split.
IN_SUBSYSTEMS = (
    "eclss", "ecs", "eps", "sps", "rcs", "gnc", "comm", "instrumentation", "structure", "propuls", "fuel",
    "cryo", "batter", "electrical", "guidance", "navigation", "docking", "s-band", "vhf", "pyro", "lighting",
    "c&w", "dps", "aps", " lm",
)

# Three-valued labels, out before in.
LABEL_OUT = (
    "alsep", "experiment", "eva", "emu", "suit", "camera", "lrv", "rover", "drill", "sample", "geolog",
    "science", "seismic", "magnetometer", "spectrometer", "sounder", "cplee", "side", "leam", " sep", "lpm", "surface",
)
LABEL_IN = (
    "eclss", "ecs", "eps", "sps", "rcs", "gnc", "comm", "instrumentation", "structure", "propuls", "fuel",
    "cryo", "batter", "electrical", "guidance", "navigation", "sequential", "docking", "s-band", "vhf", "pyro", "environ",
)
AUDIT_OUT = LABEL_OUT + ("sim-bay", "sim bay", "gfe", "government", "crew-health", "crew health", "biomed", "medical")
AUDIT_IN = LABEL_IN + (
    "dps", "aps", " lm", "lm ", "c&w", "caution", "warning", "lighting", "light", "descent", "ascent", "recovery",
)

# What makes a case unfit to be scored.
UNFAIR_SUBSYSTEMS = (
    "eva", "emu", "suit", "alsep", "experiment", "camera", "lrv", "rover", "biomed", "crew-health", "sim-bay",
    "gfe", "crew equipment", "seismic", "geolog", "magnetometer", "lpm", "thumper", "side", "cplee", "leam",
)
UNKNOWABLE = (
    "pending|tentativ|not duplicat|not reproduc|single-point|spurious|no cause|unknown|"
    "not determin|gas bubble|momentar|transient|nuisance|no hardware|benign|state of charge|no anomaly"
)

# Names by which a decision may speak of a subsystem.
ALIASES = {
    "gnc": ["gnc", "guidance", "navigation", r"\bimu\b", "gyro", "attitude", "fdai", "gimbal", "program alarm",
            "dsky", r"\bagc\b", r"\bcmc\b", "platform", "coas", "optics", "star", "align", r"\bems\b", "entry monitor",
            "pgns", r"\bags\b", "accelerometer", "noun", "verb"],
    "eclss": ["eclss", r"\becs\b", "environmental", "cool", "glycol", "water", "oxygen", r"\bo2\b", "cabin", "co2",
              "suit", "humidity", "sublimator", "evaporator", "potable", "surge tank", r"\bwms\b", "freon"],
    "eps": [r"\beps\b", "electrical", "fuel cell", "batter", r"\bbat\b", "inverter", "undervolt", "main bus", "mn bus",
            r"\bdc\b", r"\bac bus", "bus tie", "pyro", "volt", r"\bamp", "d-c", "a-c"],
    "comms": ["comm", "s-band", r"\bvhf\b", "telemetry", "antenna", "transponder", r"\bpcm\b", "voice", "subcarrier",
              "uplink", "downlink", "high gain", r"\bhga\b", r"\busb\b", "omni"],
    "rcs": [r"\brcs\b", "reaction control", "thruster", "quad", "propellant isol", "isol valve", r"\bhe 1", r"\bhe 2", r"\btca"],
    "sps": [r"\bsps\b", "service propulsion", "ball valve", "gimbal motor", r"\bpugs\b"],
    "instrumentation": ["instrumentation", "commutator", "transducer", "signal condition", "readout", "sensor", r"\bpcm\b"],
    "structures": ["structur", "hatch", "window", "docking", r"\bseal", "shade", "tunnel", "probe", "drogue", "crack"],
    "lighting": ["lighting", "spotlight", "floodlight", "integral light", r"\blamp", r"\blight"],
    "c&w": ["caution", "warning", "master alarm", "c&w", "annunciator"],
    "lm dps": ["descent propulsion", "descent engine", r"\bdps\b"],
    "dps": ["descent propulsion", "descent engine", r"\bdps\b"],
    "aps": ["ascent propulsion", "ascent engine", r"\baps\b"],
    "lm": ["lunar module", r"\blm cabin", r"\blm "],
    "eva": [r"\beva\b", r"\bemu\b", r"\bsuit", "purge", r"\bops\b", "plss", "umbilical", "opgs"],
    "alsep": ["alsep", "experiment", "seismic", "cplee", r"\bside\b", r"\bleam\b", "central station", r"\brtg\b", "magnetometer"],
    "lrv": [r"\blrv\b", "rover", "steering", "traction", "wheel"],
    "camera": ["camera", "magazine", "film", "lens"],
    "sim-bay": ["sim bay", "sim-bay", "scientific instrument", "mapping camera", "panoramic"],
    "biomed": ["biomed", "bioinstrument", r"\becg\b", "physiolog"],
    "crew-health": ["crew health", "medical", "fatigue", "illness"],
    "gfe": ["government furnished", r"\bgfe\b"],
    "crew equipment": ["stowage", "restraint", "crew equipment"],
}

# Document classes by markers of the file name, historical first.
HISTORICAL = (
    "anomaly", "corrective", "panel", "review", "investigation", "-report", "report-",
    "transcript", "press", "memo", "award", "telegram", "logbook", "console",
    "accident", "naming", "dispersion", "analysis", "fer", "-traj", "config",
    "msfn", "mcc", "stowage", "summary", "article", "presentation", "michoud",
    "construction", "westinghouse", "tv-camera", "fdlog", "-loop", "readiness",
    "postlaunch", "mission-ops-report", "5-day", "30-day", "backup-to-csm", "experiments",
)
OPERATIONAL = (
    "checklist", "procedure", "-proc", "procs", "rules", "aoh", "subs",
    "data-card", "datacard", "dictionary", "flightplan", "flight-plan", "fplan",
    "timeline", "flight-manual", "activation", "-nav-",
)

# The closed schema of extracted triples.
ENTITY_TYPES = ("Symptom", "Subsystem", "Component", "Fault", "Procedure")
RELATION_TYPES = (
    "indicates", "locatedIn", "hasComponent", "causes", "diagnosedBy", "resolvedBy", "references", "precedes",
)

# Panel words that mark a signal, and filler words of neither channel.
PANEL_WORDS = tuple(
    "bus buses undervolt undervoltage volt volts voltage amp amps alarm master caution warning "
    "light lights quantity pressure psi temperature temp gimbal program radar servo thrust attitude "
    "platform transponder telemetry valve breaker breakers helium fuel cell cells oxygen o2 ac dc ems "
    "pgncs pgns gdc fdai cdu rcs sps sce imu accelerometer barber pole bit abort circuit inverter "
    "restart reset undervolts overload disconnect".split()
)
CHANNEL_STOP = tuple(
    "the a an of to in on and or with at from for was were is are be been being this that these those "
    "it its they them their has had have will would could should may might not no nor due most probable "
    "we i he she our your okay roger copy yes now here there just got get right thing some any all only "
    "looking look see saw like about that's we've i'm it's you sir jack gene ed houston well think need".split()
)

# Sentences about what came after a fault, hardware words and mechanism words.
AFTERMATH = (
    r"postflight|bench test|x-ray|temperature test|duplicat|ground test|review board|"
    r"teardown|closed\b|no hardware|warranted|redesign|modif|relocated|improved|corrective|recommend|"
    r"powered down|lifeboat|recycl"
)
WHERE = (
    r"\b(switch|valve|tank|cell|\bbus\b|batter|capacitor|relay|connector|o-?ring|seal|"
    r"wir|cable|motor|pump|transducer|sensor|antenna|transponder|gyro|regulator|filter|bearing|actuator|"
    r"coil|module|assembly|breaker|nozzle|diode|resistor|solenoid|heater|\bfan\b|thruster|quad|inverter|"
    r"commutator|timer|gauge|indicator|\blamp|\blight|window|hatch|shade|strut|bracket|fitting|gasket|"
    r"bellows|diaphragm|orifice|chamber|housing|shaft|\bgear|spring|\bcam\b|lever|\bpin\b|bolt|\bweld|"
    r"joint|\btube|pipe|insulation|potting|\bfilm\b|\bgrid\b|filament|electrode|\bplate|contact|circuit|"
    r"harness|terminal|converter|amplifier|stylus|condenser|radiator|injector|bladder|canister|cartridge)"
)
WHY = (
    r"\b(arc|corona|short|shorted|leak|ignit|combust|swell|damag|broke|broken|breakage|"
    r"crack|worn|\bwear\b|corro|contaminat|overheat|stuck|stick|seiz|embrittle|hammer|degrad|oversize|"
    r"misalign|fatigue|ruptur|burn|melt|deform|block|clog|intermittent|transient|spike|surge|oscillat|"
    r"\bdrift|vibrat|\bshock\b|\bopen\b|separat|loose|disconnect|inadvert|erroneous|noise|marginal)"
)

# Calibration of the citation score.
CITE_MEAN_G, CITE_SD_G, CITE_MEAN_SUPPORT, CITE_SD_SUPPORT = 0.3745, 0.1408, 1.6012, 2.0534
CITE_CUT, WEAK_LEAD, CONSENSUS_CUT, COVERAGE_CUT, STRONG_IDF = -1.510, 0.40, 3, 0.38, 2.5

# The stop lists of the two studies that keep their own.
COMPONENT_STOP = tuple(
    "the a an of to in on and or with at from for was were is are be this that these those it its "
    "they them their has had have will would could should may might not no non due most probable caused "
    "cause failure failed fault anomaly report system module condition which whose found made used later "
    "when than then also into more over under between".split()
)
LOCATION_STOP = tuple(
    "the a an of to in on and or with at from for was were is are be this that these those it its "
    "they them their has had have will would could should may might not no non due most probable caused "
    "cause failure failed fault anomaly report system module condition which whose".split()
)

# Words of the aftermath in the component and in the location study.
AFTERMATH_COMPONENT = (
    r"postflight|post-flight|bench test|vibrat|x-ray|temperature test|\bduplicat|ground test|"
    r"review board|teardown|\binspect|closed\b|no hardware|warranted|redesign|\bmodif|relocated|improved|"
    r"corrective|for future|future mission|recommend|changed to|material changed|was changed|replaced"
)
AFTERMATH_LOCATION = (
    r"postflight|bench test|x-ray|temperature test|duplicat|ground test|review board|"
    r"teardown|closed\b|no hardware|warranted|redesign|modif|relocated|improved|corrective|recommend|"
    r"powered down|lifeboat|recycl"
)

# Parts of symptoms and the subsystem each belongs to, in order, of two studies.
MISSION_SUBSYSTEMS = (
    ("FDAI attitude jumped", "GNC"), ("docking probe would not extend", "structures"),
    ("cabin pressure dropped rapidly after LM jettison", "structures"),
    ("docking probe will not capture", "structures"), ("landing radar will not lock", "GNC"),
    ("water leaking from the chlorine", "ECLSS"),
    ("AC bus 2 and DC bus B undervolt", "EPS"), ("SPS secondary yaw gimbal servo", "SPS"),
    ("erroneous gimbal-lock indication", "GNC"), ("spurious master alarms with no caution", "EPS"),
    ("EMS accelerometer null-bias shift", "GNC"),
)
SIGNAL_SUBSYSTEMS = (
    ("FDAI attitude jumped", "GNC"), ("docking probe would not extend", "structures"),
    ("cabin pressure dropped rapidly after LM jettison", "structures"), ("1202 and 1201 program alarms", "GNC"),
    ("lightning strike at launch", "EPS"), ("docking probe will not capture", "structures"),
    ("landing radar will not lock", "GNC"), ("SPS thrust light on the EMS", "SPS"),
    ("water leaking from the chlorine", "ECLSS"), ("AC bus 2 and DC bus B undervolt", "EPS"),
    ("SPS secondary yaw gimbal servo", "SPS"), ("erroneous gimbal-lock indication", "GNC"),
    ("spurious master alarms with no caution", "EPS"), ("EMS accelerometer null-bias shift", "GNC"),
)

# What a diagnosis says that powers the command module down or uses the lander as a lifeboat.
POWER_DOWN = ("power down", "powerdown", "power-down", "conserve", "preserve reentry")
LANDER = ("lunar module", "lm ", "lifeboat")
LANDER_USE = ("lifeboat", "power up", "power-up", "descent batter", "aquarius")
