"""Fixed values of the triage: event rules in order, and the kinds of rejected rows."""

#: Fixed values, in order: pattern (any case), company, industry, verdict, notes.
EVENT_RULES = [
    ('biontech to close|biontech.*singapore affecting', 'BioNTech Singapore', 'Other', 'confirmed', 'BioNTech closing Germany + Singapore sites, ~1,860 staff affected globally'),
    ('temasek-backed partior|partior slashes', 'Partior', 'Tech', 'confirmed', 'Temasek-backed fintech cuts ~30% of Singaporean team after US$60M funding round'),
    ('microsoft to lay off 9000|microsoft cuts hundreds more|second wave of job', 'Microsoft', 'Tech', 'confirmed', 'Microsoft 2025 follow-up rounds (June hundreds; July 9,000) after May 6,000 cuts; incl. Singapore'),
    ('tiger beer|apb singapore|apbs', 'APBs (Tiger Beer)', 'Manufacturing', 'confirmed', 'Scaling down Tuas brewing operations; ~130 SG roles cut over 2 years'),
    ('dhl unit in singapore|dhl unit confirms', 'DHL Singapore', 'Other', 'confirmed', 'DHL Singapore confirms retrenchment of workers; scope undisclosed'),
    ('dhl unit$', 'DHL Singapore', 'Other', 'confirmed', 'DHL Singapore confirms retrenchment of workers; scope undisclosed'),
    ('exxonmobil|exxon', 'ExxonMobil Singapore', 'Other', 'confirmed', 'ExxonMobil expects to cut ~500 SG staff (10–15%) by end-2027'),
    ('jobs portal indeed|indeed shuts singapore|indeed laid off in singapore', 'Indeed', 'Tech', 'confirmed', 'Shut Singapore tech office, ~120 staff affected'),
    ('sph media', 'SPH Media', 'Other', 'confirmed', 'Layoffs across SPH Media SG operations'),
    ('moneyhero', 'MoneyHero', 'Finance', 'confirmed', 'Singapore fintech MoneyHero laid off 80 staff to cut costs'),
    ('google singapore hit by|google axes employees', 'Google', 'Tech', 'confirmed', None),
    ('tech giant google', 'Google', 'Tech', 'confirmed', 'Global Google layoffs incl. Singapore'),
    ('microsoft cutting|microsoft layoffs hit software engineers|microsoft announces global job', 'Microsoft', 'Tech', 'confirmed', 'Global Microsoft layoffs incl. Singapore'),
    ('tiktok cuts trust and safety|tiktok layoffs: job|tiktok,', 'TikTok', 'Tech', 'confirmed', None),
    ('^tiktok$', 'TikTok', 'Tech', 'confirmed', None),
    ('singapore unions offering support to.*tiktok', 'TikTok', 'Tech', 'confirmed', 'TikTok SG layoffs; NTUC support offered'),
    ('sea e-commerce arm shopee', 'Shopee', 'Tech', 'confirmed', 'Sea/Shopee layoffs in Singapore'),
    ('more layoffs at shopee', 'Shopee', 'Tech', 'confirmed', 'Additional Shopee layoffs in Singapore'),
    ('twitter.+layoffs in singapore|inside twitter', 'Twitter', 'Tech', 'confirmed', 'Twitter Singapore layoffs post-Musk takeover'),
    ('meta layoffs: singapore employees affected', 'Meta', 'Tech', 'confirmed', '2022 Meta SG layoffs'),
    ('meta layoffs hit singapore.*2022|^meta$', 'Meta', 'Tech', 'confirmed', '2022 Meta SG layoffs'),
    ('meta layoffs hit singapore', 'Meta', 'Tech', 'confirmed', None),
    ('creative technology', 'Creative Technology', 'Tech', 'confirmed', 'Singapore audio tech company restructuring'),
    ('standard chartered', 'Standard Chartered', 'Finance', 'confirmed', 'Standard Chartered Singapore layoffs reported'),
    ('we\\. communications', 'We. Communications', 'Other', 'confirmed', 'Global PR firm closed/scaled down Singapore office'),
    ('manus capital', 'Manus Capital', 'Finance', 'confirmed', 'Post-HQ relocation to Singapore, restructuring/layoffs'),
    ('cj logistics asia', 'CJ Logistics Asia', 'Other', 'confirmed', 'Logistics arm retrenchment'),
    ('crypto\\.com announces layoffs of 12%', 'Crypto.com', 'Finance', 'confirmed', '12% of staff cut in 2026 round'),
    ("crypto\\.com,.*based in s'pore|crypto\\.com.*based in s’pore", 'Crypto.com', 'Finance', 'confirmed', '2026 layoff round, ~12% of staff'),
    ('goldman .* join layoffs', 'Goldman Sachs', 'Finance', 'confirmed', 'Goldman layoffs incl. Singapore'),
    ('hsbc.*(weighs|mulls)', 'HSBC', 'Finance', 'rumored', 'HSBC weighing deep cuts globally; Singapore office potentially affected'),
    ('societe generale|soci.* g.*n.*rale', 'Société Générale', 'Finance', 'rumored', 'Plans ~1,800 job cuts globally'),
    ('atlassian', 'Atlassian', 'Tech', 'rumored', '~1,600 job cuts planned globally; SG office potentially affected'),
    ('citi moves ahead with', 'Citi', 'Finance', 'rumored', 'Citi ~1,000 job cuts moving ahead'),
    ('jack dorsey|block ceo', 'Block', 'Finance', 'rumored', 'Block (Jack Dorsey) ~4,000 job cuts globally'),
    ('wisetech', 'WiseTech', 'Tech', 'rumored', 'Plans ~2,000 job cuts globally'),
    ("nestl[eé]’s plans|nestl[eé]'s plans", 'Nestlé', 'Other', 'rumored', 'Plans ~16,000 job cuts globally'),
    ('snapchat parent', 'Snap (Snapchat)', 'Tech', 'rumored', 'Snap layoffs reported'),
    ('disney is', 'Disney', 'Other', 'rumored', 'Disney layoffs reported'),
    ('^nokia ', 'Nokia', 'Tech', 'rumored', 'Nokia preparing for layoffs incl. India/APAC'),
    ('^basf ', 'BASF', 'Manufacturing', 'rumored', 'BASF announces job cuts'),
    ('^blackrock', 'BlackRock', 'Finance', 'rumored', 'BlackRock layoffs reported'),
    ('ubs plans january', 'UBS', 'Finance', 'rumored', 'Plans January 2026 job cuts'),
    ('^apple\\b', 'Apple', 'Tech', 'rumored', 'Apple layoffs reported'),
    ('^hp to\\b', 'HP', 'Tech', 'rumored', 'HP planning further job cuts'),
    ('paypal plans', 'PayPal', 'Finance', 'rumored', 'PayPal plans job cuts'),
    ('^cloudflare', 'Cloudflare', 'Tech', 'rumored', 'Cloudflare layoffs reported'),
    ('^how many employees work at ibm', 'IBM', 'Tech', 'rumored', 'IBM layoffs reported'),
    ('sony pictures entertainment', 'Sony Pictures Entertainment', 'Other', 'rumored', 'Sony Pictures layoffs reported'),
    ('^pinterest', 'Pinterest', 'Tech', 'rumored', 'Pinterest layoffs reported'),
    ('crypto exchange gemini plans', 'Gemini', 'Finance', 'rumored', 'Gemini plans to cut staff'),
    ('heineken to', 'Heineken', 'Manufacturing', 'rumored', 'Heineken job cuts globally (parent of APBs)'),
    ('oracle plans thousands', 'Oracle', 'Tech', 'rumored', 'Oracle plans thousands more job cuts'),
    ('struggling nike will|^nike will', 'Nike', 'Other', 'rumored', 'Plans ~1,400 job cuts globally amid turnaround'),
    ('^morgan stanley\\b', 'Morgan Stanley', 'Finance', 'rumored', 'Morgan Stanley lays off ~2,500 globally; SG office potentially affected'),
    ('porsche shutters three units', 'Porsche', 'Manufacturing', 'rumored', 'Porsche shutters three units in first job cuts under new CEO'),
    ('anz latest to', 'ANZ', 'Finance', 'rumored', 'ANZ joins 2025 wave of bank/tech layoffs'),
    ('traveloka layoffs', 'Traveloka', 'Tech', 'rumored', 'Traveloka reorganising workforce around capabilities, tech and growth; SG office potentially affected'),
]

#: Fixed values, in order: kind of a rejected row, pattern (any case), and the columns it is looked for in.
REJECTED_KINDS = [
    ("commentary", "commentary:|explainer:|deep dive|opinion|analysis|why are there|what could", ("company", "notes")),
    ("policy", "parliament|mom data|mom to review|manpower minister|ntuc|advance notice|mandatory", ("company", "notes")),
    ("personal", "i got laid|laid-off tech|i applied to|i had 10|i am tired|retrenched at 22", ("company", "notes")),
    ("job-posting", "job posting|career|hirevector|hiring|indeed|glassdoor|linkedin", ("source_link", "notes")),
    ("statistics", "labour market|employment growth|1,270 layoffs|43%|retrenchments rise", ("company", "notes")),
    ("not-sg", "not-sg|no (?:clear )?singapore nexus|no mention of singapore|does not mention.*singapore|no singapore", ("notes",)),
    ("aggregator", "aggregator|covering (?:many|multiple) companies|multiple companies|list of.*layoffs|tracker", ("notes",)),
]
