"""Fixed values. They decide which mails are kept and how they read, so they are data, not style."""

# Traces of mail transport; a text holding any of them is not prose.
NOISE_PATTERNS = (
    "content-transfer-encoding",
    "content-type:",
    "content-id:",
    "image/gif",
    "image/jpeg",
    "image/png",
    "application/",
    "multipart/",
    "boundary=",
    "charset=",
    "name=",
    "filename=",
    "base64",
    "quoted-printable",
)

MIN_CHARS = 10
LANG_SAMPLE_CHARS = 1000

SUBJECT_MARK = "[SUBJECT]"
BODY_MARK = "[BODY]"
NO_SUBJECT = "[NO SUBJECT]"
NO_BODY = "[NO BODY]"

# Token ids 0..6 of every vocabulary, in this order.
RESERVED_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", SUBJECT_MARK, BODY_MARK)
MAX_LENGTH = 512

# TF-IDF limits and smoothing.
MAX_FEATURES = 50000
MIN_DF = 2
MAX_DF = 0.95
NB_ALPHA = 1.0
LR_C = 1.0
LR_MAX_ITER = 1000

# Corpus sizes and split.
SAMPLE_SIZE = 5000
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
SEED = 42

# Explanation.
NUM_SAMPLES = 1000
NUM_FEATURES = 10
KERNEL_WIDTH = 25.0

# A training run.
MODEL_NAME = "naive_bayes"
BATCH_SIZE = 16
LEARNING_RATE = 2e-5
NUM_EPOCHS = 10
WARMUP_STEPS = 100
WEIGHT_DECAY = 0.01
ACCUMULATION_STEPS = 4
PATIENCE = 3
THRESHOLD = 0.5

# The public list of 318 English stop words that machine-learning libraries ship.
STOP_WORDS = tuple(
    """
    a about above across after afterwards again against all almost alone along already also although
    always am among amongst amoungst amount an and another any anyhow anyone anything anyway
    anywhere are around as at back be became because become becomes becoming been before beforehand
    behind being below beside besides between beyond bill both bottom but by call can cannot cant co
    con could couldnt cry de describe detail do done down due during each eg eight either eleven
    else elsewhere empty enough etc even ever every everyone everything everywhere except few
    fifteen fifty fill find fire first five for former formerly forty found four from front full
    further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers
    herself him himself his how however hundred i ie if in inc indeed interest into is it its itself
    keep last latter latterly least less ltd made many may me meanwhile might mill mine more
    moreover most mostly move much must my myself name namely neither never nevertheless next nine
    no nobody none noone nor not nothing now nowhere of off often on once one only onto or other
    others otherwise our ours ourselves out over own part per perhaps please put rather re same see
    seem seemed seeming seems serious several she should show side since sincere six sixty so some
    somehow someone something sometime sometimes somewhere still such system take ten than that the
    their them themselves then thence there thereafter thereby therefore therein thereupon these
    they thick thin third this those though three through throughout thru thus to together too top
    toward towards twelve twenty two un under until up upon us very via was we well were what
    whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
    whether which while whither who whoever whole whom whose why will with within without would yet
    you your yours yourself yourselves
    """.split()
)
